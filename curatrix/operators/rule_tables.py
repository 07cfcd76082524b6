"""Ordered rules as rows of a table: the first one by rank whose anchor a text has decides, however many rules there are.

A rule has rank, kind (equals, prefix, suffix, contains), anchor, route and target; ranks are distinct. Anchors and texts
are compared as ``plain_label`` gives them. The rules go out to all tasks as one automaton that finds all anchors in one
pass over a text, behind a check of their size; a larger table is joined by keys, the pieces of a text that are as long as
some anchor. The plan has the same size for any number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from curatrix.functions.unicode import nfkc
from curatrix.sources.files import staged

RULES = "rank long, kind string, anchor string, route string, target string"
KINDS = ("equals", "prefix", "suffix", "contains")
#: Characters of all anchors that are sent out as an automaton.
SENT = 8 << 20


def plain_label(text: Column) -> Column:
    """Compatibility forms folded, quotes taken out, white space single, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(nfkc(text), "[“”‘’\"'`]", ""), r"\s+", " ")))


def _automaton(rules: list[tuple[int, str, str]]):
    import ahocorasick

    found: dict[str, list[tuple[int, str]]] = {}
    for rank, kind, anchor in rules:
        found.setdefault(anchor, []).append((rank, kind))
    a = ahocorasick.Automaton()
    for anchor, its in found.items():
        a.add_word(anchor, (len(anchor), its))
    a.make_automaton()
    return a


def _first_ranks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        automaton = _automaton(rules) if rules else None
        for batch in batches:
            ranks = []
            for text in batch.column("text").to_pylist():
                best, last = None, len(text) - 1
                for end, (size, its) in automaton.iter(text) if automaton and text else ():
                    whole = (end == size - 1, end == last)
                    for rank, kind in its:
                        if (best is None or rank < best) and (kind == "contains" or (kind == "prefix" and whole[0]) or (kind == "suffix" and whole[1]) or (kind == "equals" and all(whole))):
                            best = rank
                ranks.append(best)
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(ranks, pa.int64())], names=["text", "rank"])

    return run


def _joined(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by keys: pieces of a text of the anchors' lengths."""
    sizes = [r.n for r in rules.select(F.length("anchor").alias("n")).distinct().collect()]  # lengths, not rules
    n = F.length("text")
    fit = F.filter(F.array(*map(F.lit, sizes or [0])), lambda k: (k <= n) & (k > 0))
    pieces = F.flatten(F.transform(fit, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(F.substr("text", i, k).alias("anchor"), (i == 1).alias("first"), (i == n - k + 1).alias("last")))))
    keys = texts.select("text", F.explode(pieces).alias("p")).select("text", "p.*")
    ok = (F.col("kind") == "contains") | ((F.col("kind") == "prefix") & F.col("first")) | ((F.col("kind") == "suffix") & F.col("last")) | ((F.col("kind") == "equals") & F.col("first") & F.col("last"))
    return keys.join(rules.select("rank", "kind", "anchor"), "anchor").where(ok).groupBy("text").agg(F.min("rank").alias("rank"))


def first_rules(rows: DataFrame, text: str, rules: DataFrame, sent: int = SENT) -> DataFrame:
    """The rows with rank, route and target of the first rule that their text meets; null where none does. A null text
    counts as empty, and rules without an anchor meet nothing."""
    known = staged(rules.select("rank", "kind", plain_label(F.col("anchor")).alias("anchor"), "route", "target").where("anchor <> ''"))
    texted = rows.withColumn("__text", plain_label(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    size = known.agg(F.coalesce(F.sum(F.length("anchor") + 8), F.lit(0))).first()[0]
    decided = known.select(F.col("rank").alias("__rank"), "route", "target")
    if size <= sent:
        found = rows.sparkSession.sparkContext.broadcast([(r.rank, r.kind, r.anchor) for r in known.select("rank", "kind", "anchor").collect()])
        # each row keeps its place: the text goes through the automaton with the row beside it
        packed = texted.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("__text").alias("text"))
        ranked = packed.mapInArrow(_beside(found), StructType([*packed.schema.fields, StructField("rank", LongType())])).select("row.*", F.col("rank").alias("__rank"))
    else:
        best = _joined(texted.select(F.col("__text").alias("text")).distinct(), known).select(F.col("text").alias("__text"), F.col("rank").alias("__rank"))
        ranked = texted.join(best, "__text", "left").drop("__text")
    return ranked.join(decided, "__rank", "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__rank").alias("rank"), "route", "target")


def _beside(shared):
    plain = _first_ranks(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(plain(iter([batch.select(["text"])])))
            yield pa.RecordBatch.from_arrays([*batch.columns, found.column("rank")], names=[*batch.schema.names, "rank"])

    return run


def analysis(labels: DataFrame, item: str, label: str, rules: DataFrame, otherwise: str = "unclassified", samples: int = 10, sent: int = SENT) -> DataFrame:
    """route, key, label, n_items, n_labels, sample: the distinct labels of items routed by rules and counted. The key is the
    rule's target, or the plain label where the rule has none or none fits; ``label`` is the most frequent spelling (the
    smallest of equal ones), ``n_labels`` how many spellings there are, ``sample`` the first items.

    Rules see each distinct label once; labels of a hot key are counted per item and spelling before keys meet."""
    rows = labels.select(F.col(item).alias("item"), F.col(label).alias("label")).where(plain_label(F.coalesce(label, F.lit(""))) != "").distinct()
    spelt = staged(rows.groupBy("label").agg(F.count("*").alias("n")))
    routed = staged(first_rules(spelt.select("label"), "label", rules, sent).select("label", F.coalesce("route", F.lit(otherwise)).alias("route"), F.coalesce(F.nullif("target", F.lit("")), plain_label(F.col("label"))).alias("key")))
    kinds = spelt.join(routed, "label").groupBy("route", "key").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.count("*").alias("n_labels"))
    items = rows.join(routed, "label").select("route", "key", "item").distinct()
    counts = items.groupBy("route", "key").agg(F.count("*").alias("n_items"))
    first = items.withColumn("__rn", F.row_number().over(W.partitionBy("route", "key").orderBy("item"))).where(F.col("__rn") <= samples)
    some = first.groupBy("route", "key").agg(F.array_sort(F.collect_list("item")).alias("sample"))
    return counts.join(kinds, ["route", "key"]).join(some, ["route", "key"]).select("route", "key", "label", "n_items", "n_labels", "sample")
