"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. A ledger is a folder of the shared storage that holds,
for each blob, the (rule, version) pairs it has been scanned with and the spans found; each scan adds a folder of its own.
A scan reads the ledger, takes only blobs that lack some current pair, applies just the missing rules, adds what it found,
and joins the findings back to every path (document row) that holds the blob. The session's ``spark.curatrix.ledger.dir``
names a ledger that is kept from run to run; without it a run begins a new one, in which everything is unseen.

Defined cases: null text counts as empty; a text without findings has zero counts and empty span strings; a very long text
is scanned whole; of matches that begin at the same place the rules' order decides; repeated rows give repeated result
rows; rows with a null id are kept; an empty table gives an empty result; other columns of the input are ignored. Spans
count code points, end exclusive. ``redact`` keeps all columns of its input, whatever their names, and null texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import checkpoint_dir, sliced, strings, texts


class Rule(NamedTuple):
    """A rule finds ``pattern``; group ``group`` of a match must have ``least`` characters. ``hints``: a text without
    any of them (after ASCII lower-casing) can't match."""

    kind: str
    version: int
    pattern: str
    flags: int
    group: int
    least: int
    hints: tuple[bytes, ...]


RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6, (b"passw", b"secret", b"token", b"api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 20, (b"akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 0, 24, ()),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, 1, (b"-----begin ",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, 1, (b"eyj",)),
    Rule("hosting", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, 1, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
)
BASE = ("assign", "access", "hex")

FOUND = "array<struct<kind:string,version:int,spans:array<struct<start:long,end:long>>>>"
LEDGER = f"blob string, found {FOUND}"


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of one rule that are long enough."""
    return [m.span() for m in re.compile(rule.pattern, rule.flags).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
        for batch in sliced(batches):
            blobs, contents, pending = batch.column(0), strings(batch.column(1)), batch.column(2).to_pylist()
            found = []
            for i, todo in enumerate(pending):
                text = contents[i]
                low = text.encode("utf-8", "surrogatepass").lower()
                found.append(
                    [
                        {"kind": r.kind, "version": r.version, "spans": [{"start": a, "end": b} for a, b in spans_of(text, r)] if not r.hints or any(h in low for h in r.hints) else []}
                        for r in rules
                        if f"{r.kind}:{r.version}" in todo
                    ]
                )
            yield pa.RecordBatch.from_arrays([blobs, pa.array(found, kind)], names=["blob", "found"])

    return scan


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the content address of each version."""
    return texts(docs, id_col, text_col).withColumn("blob", _address("text"))


def _address(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def new_ledger(spark: SparkSession) -> str:
    """The ledger that the session keeps, or the place of a new one, which goes when the session's JVM ends."""
    kept = spark.conf.get("spark.curatrix.ledger.dir", None)
    if kept:
        return kept
    path = f"{checkpoint_dir(spark)}/ledgers/{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """blob and found of all earlier scans; a blob has one row for each scan that added pairs. A scan that broke off
    has left nothing, since its rows are put in place only when all are written."""
    scans = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/scan-*/_SUCCESS")
    done = scans.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(scans)
    folders = [str(x.getPath().getParent().toString()) for x in done or []]
    return spark.read.schema(LEDGER).parquet(*folders) if folders else spark.createDataFrame([], LEDGER)


def _pairs(rules: tuple[Rule, ...]):
    return F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])


def _named(f):
    return F.concat_ws(":", f["kind"], f["version"].cast("string"))


def scan_unseen(docs: DataFrame, seen: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """blob and found: each distinct blob that lacks a current pair, scanned with the rules it lacks. Copies meet in a
    map-side combined aggregate, so a text moves once per task that holds it; the ledger joins on the same key."""
    blobs = versions(docs, id_col, text_col).groupBy("blob").agg(F.first("text").alias("text"))
    have = seen.groupBy("blob").agg(F.flatten(F.collect_list(F.transform("found", _named))).alias("have"))
    pending = F.array_except(_pairs(rules), F.coalesce("have", F.array().cast("array<string>")))
    todo = blobs.join(have, "blob", "left").select("blob", "text", pending.alias("pending")).where(F.size("pending") > 0)
    return todo.mapInArrow(_scanner(rules), LEDGER)


def record(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scans what the ledger at ``path`` lacks and adds it. Gives blob, found and whether this scan found it (``fresh``),
    current pairs only."""
    spark = docs.sparkSession
    before = ledger(spark, path)
    added = f"{path}/scan-{uuid.uuid4().hex}"
    scan_unseen(docs, before, rules, id_col, text_col).write.option("compression", "zstd").parquet(added)
    rows = before.withColumn("fresh", F.lit(False)).unionByName(spark.read.schema(LEDGER).parquet(added).withColumn("fresh", F.lit(True)))
    return rows.withColumn("found", F.filter("found", lambda f: F.array_contains(_pairs(rules), _named(f)))).where(F.size("found") > 0)


def findings(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, found spans, and how many pairs of the blob this scan made and took over, of every path. A blob with
    very many paths is one join key with small rows; adaptive skew handling splits them, since the other side has one."""
    known = record(docs, path or new_ledger(docs.sparkSession), rules, id_col, text_col)
    count = lambda fresh: F.coalesce(F.sum(F.when(F.col("fresh") == fresh, F.size("found"))), F.lit(0)).cast("long")
    merged = known.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"), count(True).alias("scanned"), count(False).alias("reused"))
    return versions(docs, id_col, text_col).select("doc_id", "blob").join(merged, "blob", "left").select("doc_id", "blob", "found", "scanned", "reused")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and span strings per document."""
    order = {r.kind: i for i, r in enumerate(rules)}
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), rank[f["kind"]].alias("rank"), s["end"].alias("end"), f["kind"].alias("kind")))))
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return (
        found.withColumn("all", F.array_sort(flat))
        .select("doc_id", "blob", "scanned", "reused", "all", F.filter("all", lambda s: s["kind"].isin(*BASE)).alias("base"))
        .select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(show("base"), 256).alias("base_sha256"), show("all").alias("spans"), "blob", "scanned", "reused")
    )


PLACEHOLDER = "[SECRET]"


def _without(text: str, found: list) -> str:
    """The text with a placeholder for each stretch that spans cover."""
    at, parts = 0, []
    for a, b in sorted((s["start"], s["end"]) for f in found for s in f["spans"]):
        if b <= at:
            continue
        if a >= at:
            parts += [text[at:a], PLACEHOLDER]
        at = b
    return "".join([*parts, text[at:]])


def _redact(names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns, found = batch.column(0).flatten(), batch.column(1)
            dirty = [i for i, ok in enumerate(found.is_valid().to_pylist()) if ok]
            if dirty:
                at = names.index(text_col)
                new = [b if b is None else b.decode("utf-8", "replace") for b in columns[at].cast(pa.binary()).to_pylist()]
                for i in dirty:
                    new[i] = _without(new[i], found[i].as_py())
                columns[at] = pa.array(new, pa.string())
                if "n_chars" in names:
                    n = columns[names.index("n_chars")].to_pylist()
                    for i in dirty:
                        n[i] = len(new[i])
                    columns[names.index("n_chars")] = pa.array(n, columns[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None, text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by a placeholder and n_chars, if there, brought up to date. Blobs are
    scanned once; those with findings, which the ledger then holds, join the rows, and one pass replaces the spans."""
    known = record(docs, path or new_ledger(docs.sparkSession), rules, text_col=text_col)
    spans = F.filter("found", lambda f: F.size(f["spans"]) > 0)
    hit = known.select("blob", spans.alias("found")).where(F.size("found") > 0).groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _address(text_col).alias("blob"))
    return rows.join(hit, "blob", "left").select("row", "found").mapInArrow(_redact(docs.columns, text_col), docs.schema)
