"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a nonzero vector of radius + 1 bits; each nonzero vector v keeps the positions whose product
with v is odd. For any set of at most radius differing positions some v is orthogonal to all of them, so two
fingerprints within the radius always agree under some mask: no pair is lost.

Documents first fall together by fingerprint; only distinct fingerprints are searched. A bucket of up to
``block`` fingerprints is compared inside one task and gives a spanning forest, never all pairs. Larger buckets take
an exact way that has no large groups: a fingerprint and its one-bit neighbours become keys, at most 65 fingerprints
can share one, and two of them share one exactly if they differ in at most two bits (so this way holds for radius 2,
and, with the fingerprint alone as key, 0).

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; a very long
text counts whole; a bit set in just half of the hashes is not set; rows with a null id keep their row and don't count
for component ids; repeated rows fall into one component; an empty table gives an empty result; other columns, of
whatever names, are ignored, and ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import one_of_each, texts, written
from curatrix.llm.graph import components

RADIUS, SHINGLE, BLOCK = 2, 3, 256


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask per nonzero vector of radius + 1 bits, as unsigned integers."""
    top = (1 << radius + 1) - 1
    marks = [i % top + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(marks) if (m & v).bit_count() % 2) for v in range(1, top + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; repeats count."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 15):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 15)], stops[k : k + (1 << 15)], strict=True)], np.uint64)
        planes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += planes.sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(starts)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            got = [signed(fingerprint(x.as_py(), width)) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every document."""
    return texts(docs, id_col, text_col).mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member of its part) for the members of one bucket that link to another."""
    plain = fps.view(np.uint64)  # bits of signed numbers would be those of their absolute values
    near = np.bitwise_count(plain[:, None] ^ plain[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        least = np.where(near, label[None, :], len(fps)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    own = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(fps[own].tolist(), fps[label[own]].tolist(), strict=True))


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            pairs = [p for a, b in zip(offsets[:-1], offsets[1:], strict=True) for p in _forest(np.sort(values[a:b]), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """u, v: links that connect exactly the distinct fingerprints ``fp`` within the radius."""
    if radius not in (0, 1, 2):
        raise ValueError("the exact way for large buckets holds for a radius of at most 2")
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(radius))])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(sizes, ["t", "key"])
    small = sized.where(F.col("n") <= block).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_bucket_links(radius), "u long, v long")
    rest = sized.where(F.col("n") > block).select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)]
    spread = rest.select("fp", F.explode(F.array(*near[: 65 if radius else 1])).alias("key"))
    if radius == 1:
        # one bit apart: one of the two is the other's neighbour, so a key counts only if it is itself a fingerprint
        spread = spread.join(rest.select(F.col("fp").alias("key")), "key", "left_semi")
    lead = spread.groupBy("key").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("key", "v")
    large = spread.join(lead, "key").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return small.unionByName(large).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the component) of every document."""
    prints = written(fingerprints(docs, width, id_col, text_col))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(distinct.select("fp"), radius, block)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    members = classes.join(firsts, "root").select("fp", "component_id")
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp) -> "F.Column":
    """16 lower-case hex digits of the unsigned fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """The documents without near-duplicates: of each component the rows of its smallest doc_id stay, and of rows repeated
    in all columns one. Rows without an id stay."""
    return one_of_each(docs, near_duplicates(docs, radius, width).where("doc_id <> component_id").select("doc_id").distinct())
