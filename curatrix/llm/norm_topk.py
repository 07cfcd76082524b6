"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into buckets over the whole table, longest first. All queries meet the first bucket; the
k-th best product there gives each query's threshold, and divided by the query's length the shortest candidate that can
still matter. Queries of like need form blocks, and only the (block, bucket) pairs whose lengths can reach the threshold
are formed at all. Inside a pair candidates stand in smaller buckets, again longest first: the threshold so far, over the
query's length and the bucket's largest length, is a local cosine threshold. Over 1 the bucket is skipped; where it is
high, candidates are pruned by the range that the query's largest coordinates allow; else by length alone. What is left
is verified with exact integer products. Pruning is never strict on ties. The lists are merged by one window per query.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of other
dimension than the query are no candidates; ties go to the smaller id; rows with a null id take no part; of
repeated rows with one id each counts as a candidate row of its own, equal query rows as one query; components of any
finite size are taken exactly, and a product beyond a long counts as the nearest long; an empty table gives an empty
result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import written

#: Vectors in a small bucket; most length buckets, and need buckets, of the whole table; numbers in a group of candidates
#: and in a block of queries.
SCALE, TOP, BUCKET, BUCKETS = 1024, 10, 256, 64
SHARD_SIZE, BLOCK_SIZE = 1 << 21, 1 << 18
_NONE, _LONG = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, the vector as doubles, its dimension, and a bound of the length of floor(scale * x); unusable vectors are
    left out."""
    good = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("x"))
        .where(F.col("vec_id").isNotNull() & (F.size("x") > 0))
        .where(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))))
    )
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(F.abs(c) * scale + 1, F.lit(2.0))))
    return good.select("vec_id", "x", F.size("x").alias("dim"), length.alias("length"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, dim)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as Python integers; doubles from 2^52 on are whole."""
    exact = lambda c: int(c) * SCALE if abs(c) >= 2.0**52 else int(np.floor(c * SCALE))
    return np.array([[exact(c) for c in row] for row in x.tolist()], object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of floor(SCALE * x) of all rows, exact, clipped to a long: by floating point where sums stay below 2^53,
    by Python integers for the rows that don't allow that."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        fa, fb = np.floor(a * SCALE), np.floor(b * SCALE)
    top_a, top_b = np.abs(fa).max(axis=1), np.abs(fb).max(axis=1)
    if top_a.max() * top_b.max() * a.shape[1] < 2.0**53:
        return np.rint(fa @ fb.T).astype(np.int64)
    limit = np.sqrt(2.0**53 / a.shape[1]) * (1 - 1e-9)
    small_a, small_b = np.flatnonzero(top_a < limit), np.flatnonzero(top_b < limit)
    out = np.zeros((len(a), len(b)), np.int64)
    out[np.ix_(small_a, small_b)] = np.rint(fa[small_a] @ fb[small_b].T).astype(np.int64)

    def by_integers(rows: np.ndarray, cols: np.ndarray) -> None:
        if len(rows) and len(cols):
            got = _whole(a[rows]) @ _whole(b[cols]).T
            out[np.ix_(rows, cols)] = np.array([[min(max(s, _NONE), _LONG) for s in row] for row in got], np.int64)

    by_integers(np.flatnonzero(top_a >= limit), np.arange(len(b)))
    by_integers(small_a, np.flatnonzero(top_b >= limit))
    return out


class _Best:
    """The k best (score, id) of each query so far, ties to smaller ids; ``floor`` is what a score must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.lists = k, [[] for _ in floor]
        self.floor = floor.astype(np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor[q]
        if not keep.any():
            return
        scores, ids = scores[keep], ids[keep]
        old = self.lists[q]
        if old:
            scores, ids = np.concatenate([old[0], scores]), np.concatenate([old[1], ids])
        first = np.lexsort((ids, ~scores))[: self.k]  # ~x falls as x rises, for every long
        self.lists[q] = (scores[first], ids[first])
        if len(first) == self.k:
            self.floor[q] = max(self.floor[q], scores[first[-1]])

    def reach(self) -> np.ndarray:
        return np.where(self.floor == _NONE, -np.inf, self.floor.astype(np.float64))


def search_block(query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = TOP, bucket: int = BUCKET) -> list[tuple[int, int, int]]:
    """(query, candidate, score): each query's k best of these candidates that reach its floor, itself left out."""
    with np.errstate(over="ignore"):
        lengths = np.sqrt((np.floor(vectors * SCALE) ** 2).sum(axis=1))
        whole = np.floor(queries * SCALE)
        q_len = np.sqrt((whole**2).sum(axis=1))
    order = np.lexsort((ids, -lengths))
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    focus = np.argsort(-np.abs(queries), axis=1)[:, :3]
    best = _Best(floor, k)
    slack = 1e-9
    for at in range(0, len(ids), bucket):
        b_ids, b_vec, b_len = ids[at : at + bucket], vectors[at : at + bucket], lengths[at : at + bucket]
        reach, longest = best.reach(), b_len[0]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            local = reach / (q_len * longest)
        local = np.where(np.isnan(local), -np.inf, local)
        open_ = np.flatnonzero(local <= 1 + slack)
        if not open_.size:
            continue
        steep = (local[open_] >= 0.5) & np.isfinite(q_len[open_] * longest)
        plain = open_[~steep]
        for part in (plain[i : i + 64] for i in range(0, len(plain), 64)):
            # length pruning: only a prefix of the bucket can reach the smallest threshold of these queries
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.min(np.where(q_len[part] > 0, reach[part] / q_len[part], -np.inf))
            upto = int(np.searchsorted(-b_len, -(need - abs(need) * slack), side="right")) if np.isfinite(need) else len(b_ids)
            if not upto:
                continue
            scores = products(queries[part], b_vec[:upto])
            for row in np.flatnonzero((scores >= best.floor[part, None]).any(axis=1)).tolist():
                q = part[row]
                other = b_ids[:upto] != query_ids[q]
                best.add(q, scores[row][other], b_ids[:upto][other])
        if steep.any():
            unit = np.floor(b_vec * SCALE) / np.where(b_len > 0, b_len, 1)[:, None]
        for q in open_[steep].tolist():
            # coordinate pruning: a cosine of at least t bounds each coordinate of the candidate's direction
            t = min(1.0, local[q])
            c = whole[q, focus[q]] / q_len[q]
            width = np.sqrt(np.maximum(0, (1 - t * t) * (1 - c * c))) + 1e-7
            high = np.where(c > t, 1.0, c * t + width) + 1e-7
            low = np.where(c < -t, -1.0, c * t - width) - 1e-7
            mine = unit[:, focus[q]]
            keep = np.flatnonzero((b_ids != query_ids[q]) & (mine >= low).all(axis=1) & (mine <= high).all(axis=1))
            if keep.size:
                best.add(q, products(queries[q][None, :], b_vec[keep])[0], b_ids[keep])
    return [(int(query_ids[q]), int(i), int(s)) for q, got in enumerate(best.lists) if len(got) for s, i in zip(got[0].tolist(), got[1].tolist(), strict=True)]


def _pair(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            dim = len(queries.column("x")[0])
            rows = search_block(queries.column("vec_id").to_numpy(), _matrix(queries.column("x"), dim), queries.column("floor").to_numpy(), candidates.column("vec_id").to_numpy(), _matrix(candidates.column("x"), dim), k)
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


FOUND = "query_id long, vec_id long, score long"


def _step(value: Column, edges: list[float]) -> Column:
    """How many edges lie above the value: 0 for the largest values."""
    return sum(((value < F.lit(e)).cast("int") for e in edges), F.lit(0))


def _edges(rows: DataFrame, column: str, parts: int) -> list[float]:
    """Values that part the rows into about equal shares; fewer where many rows are equal."""
    if parts < 2:
        return []
    got = rows.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(got or []))


def _met(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    keys = ["dim", "block", "shard"]
    return queries.select(*keys, "vec_id", "x", "floor").groupBy(*keys).cogroup(candidates.select(*keys, "vec_id", "x").groupBy(*keys)).applyInArrow(_pair(k), FOUND)


def top_products(vectors: DataFrame, query_where: str = "vec_id % 100 = 0", k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, block_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products. A pair of a block and a shard is
    one group of bounded size. Brought to the driver: counts and bounds of at most BUCKETS buckets; nothing is sent out."""
    data = written(usable(vectors, id_col, vector_col).withColumn("at", F.monotonically_increasing_id()))
    queries = written(data.where(query_where).dropDuplicates(["vec_id", "x"]).select("vec_id", "x", "dim", "length"))
    total = data.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    asked = queries.count()
    shard_rows, block_rows = shard_rows or max(1, SHARD_SIZE // (total["dim"] or 1)), block_rows or max(1, BLOCK_SIZE // (total["dim"] or 1))
    edges = _edges(data, "length", min(BUCKETS, -(-total["n"] // shard_rows)))
    placed = data.withColumn("bucket", _step(F.col("length"), edges))
    sizes = {r["bucket"]: r for r in placed.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()}
    if not sizes or not asked:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    spark = vectors.sparkSession
    shards = {b: max(1, -(-r["n"] // shard_rows)) for b, r in sizes.items()}
    deal = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    name = lambda *parts: F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    # at most BUCKETS rows
    dealt = F.broadcast(spark.createDataFrame(list(shards.items()), "bucket int, shards int"))
    placed = placed.join(dealt, "bucket").withColumn("s", deal("at", F.col("shards"))).withColumn("shard", name("bucket", "s")).drop("shards", "s")

    # every query against the longest vectors
    blocks = -(-asked // block_rows)
    lead = queries.select("vec_id", "x", "dim", deal("vec_id", F.lit(blocks)).cast("string").alias("block"), F.lit(_NONE).alias("floor"), F.lit(0).alias("bucket"), every(F.lit(shards[0])).alias("s")).withColumn("shard", name("bucket", "s"))
    longest = placed.where("bucket = 0").withColumn("b", every(F.lit(blocks))).withColumn("block", F.col("b").cast("string"))
    first = written(best(_met(lead, longest, k)).select("query_id", "vec_id", "score"))
    if len(sizes) == 1:
        return best(first).select("query_id", "rank", "vec_id", "score")

    # the rest, where lengths can reach the thresholds
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    need = F.coalesce(F.col("floor") / F.col("length") * (1 - 1e-9), F.lit(-1.0))
    ready = written(queries.join(floors, "vec_id", "left").select("vec_id", "x", "dim", F.coalesce("floor", F.lit(_NONE)).alias("floor"), need.alias("need")))
    grouped = ready.withColumn("group", _step(F.col("need"), _edges(ready, "need", min(BUCKETS, blocks))))
    needs = {r["group"]: r for r in grouped.groupBy("group").agg(F.count("*").alias("n"), F.min("need").alias("need")).collect()}
    pairs = [(g, b, max(1, -(-r["n"] // block_rows)), shards[b]) for g, r in needs.items() for b in sizes if b and sizes[b]["longest"] >= r["need"]]
    # at most BUCKETS x BUCKETS rows
    pairs = F.broadcast(spark.createDataFrame(pairs, "group int, bucket int, parts int, shards int"))
    asked_rows = grouped.join(pairs, "group").withColumn("p", deal("vec_id", F.col("parts"))).withColumn("block", name("group", "p")).withColumn("s", every(F.col("shards"))).withColumn("shard", name("bucket", "s"))
    offered = placed.where("bucket > 0").join(pairs, "bucket").withColumn("p", every(F.col("parts"))).withColumn("block", name("group", "p"))
    return best(first.unionByName(_met(asked_rows, offered, k))).select("query_id", "rank", "vec_id", "score")
