"""Greedy choice under caps, in rounds instead of one after the other: each query in turn takes its best candidate whose keys
(the listing itself, its creator, its series) have room left.

In a round every undecided query looks at its best candidate that is left. It may take it for good if none of the keys can
run out before its turn, that is if fewer undecided queries before it are interested in the key at all than the key has
room. The first undecided query always may, and with orders that have nothing to do with the keys a share of all does, so
rounds grow like the logarithm of the number of queries. A chain in which each query waits for the one before would cost a
round per link, and so would keys that all queries want. So a round first decides the first queries one after the other in
one task, as many as have few rows in all, and looks at all others only while that decides more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.sources.files import staged

#: Rows of the first undecided queries that one task decides in a round.
FEW = 20_000


def _decided_in_turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sequential loop; ``room`` is what each key of a row has left before all of these."""
    rows = pd.concat(list(frames), ignore_index=True).sort_values(["q", "place"])
    room: dict[str, int] = {}
    for keys, left in zip(rows["keys"], rows["room"], strict=True):
        room.update(zip(keys, left, strict=True))
    out, done = [], None
    for q, row, keys in zip(rows["q"], rows["row"], rows["keys"], strict=True):
        if q != done and all(room[k] > 0 for k in keys):
            done = q
            out.append((q, row))
            for k in keys:
                room[k] -= 1
    yield pd.DataFrame(out, columns=["q", "row"]).astype("int64")


def taken_in_turn(candidates: DataFrame, query: str, place: list[str], caps: dict[str, tuple[list[str], int]], few: int = FEW) -> tuple[DataFrame, int]:
    """The candidates that queries take, and the number of rounds. ``query`` is a whole number, in whose order queries come
    to their turn; ``place`` are columns by which a query prefers its candidates, total within a query. ``caps`` names keys:
    columns and how often their values may be taken; null is a value like any other."""
    spark = candidates.sparkSession
    key = lambda name, columns: F.to_json(F.struct(F.lit(name).alias("of"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]))
    most = max(cap for _, cap in caps.values())
    rows = staged(candidates.withColumn("__row", F.monotonically_increasing_id()))
    names = [f"k{i}" for i in range(len(caps))]
    narrow = rows.select(F.col(query).cast("long").alias("q"), F.col("__row").alias("row"), F.struct(*place, F.col("__row")).alias("place"), *[key(n, columns).alias(k) for k, (n, (columns, _)) in zip(names, caps.items(), strict=True)])
    cap_of = F.coalesce(*[F.when(F.get_json_object("key", "$.of") == n, F.lit(cap)) for n, (_, cap) in caps.items()])
    base = left = staged(narrow)
    size = n = left.count()
    taken, rounds = spark.createDataFrame([], "q long, row long"), 0
    decided, used = spark.createDataFrame([], "q long"), spark.createDataFrame([], "key string, n long")
    # how many rounds are to pass before all queries are looked at again
    wait, pause = 0, 1
    while n:
        rounds += 1
        keys = F.array(*names)
        before = decided.count()
        first = _first_queries(left, few) if few else None
        if first is not None:
            # at most ``few`` rows, counted there
            some = left.where(F.col("q") <= first)
            room = some.select("q", "row", "place", F.posexplode(keys).alias("i", "key")).join(used, "key", "left").groupBy("q", "row", "place").agg(F.array_sort(F.collect_list(F.struct("i", "key", (cap_of - F.coalesce("n", F.lit(0))).alias("room")))).alias("k"))
            order = F.row_number().over(W.orderBy("q", "place"))
            won = staged(room.select("q", "row", order.alias("place"), F.col("k.key").alias("keys"), F.col("k.room").alias("room")).coalesce(1).mapInPandas(_decided_in_turn, "q long, row long"))
            taken, used, decided = _noted(taken, used, decided, won, won.join(some.select("row", keys.alias("keys")), "row"), some.select("q").distinct())
            left = _left(base, decided, used, cap_of, names)
        in_turn = decided.count()
        if first is None or wait == 0:
            turn = F.row_number().over(W.partitionBy("key").orderBy("q"))
            counted = left.select("q", F.explode(keys).alias("key"))
            sure = counted.distinct().withColumn("turn", turn).where(F.col("turn") <= most).join(used, "key", "left").where(F.col("turn") <= cap_of - F.coalesce("n", F.lit(0))).select("q", "key")
            best = left.groupBy("q").agg(F.min_by(F.struct("row", keys.alias("keys")), "place").alias("b")).select("q", "b.*")
            met = best.select("q", "row", F.explode("keys").alias("key")).join(sure, ["q", "key"]).groupBy("q", "row").agg(F.collect_list("key").alias("keys"))
            won = staged(met.where(F.size("keys") == len(caps)))
            taken, used, decided = _noted(taken, used, decided, won.select("q", "row"), won, won.select("q"))
            left = _left(base, decided, used, cap_of, names)
            # where all wait for few keys, looking at all of them decides less than taking some in turn
            wait = pause if decided.count() - in_turn < in_turn - before else 0
            pause = 2 * pause if wait else 1
        else:
            wait -= 1
        n = left.count()
        if n <= size // 2:
            base, size = staged(left), n
            left = base
    out = rows.join(taken.select(F.col("row").alias("__row")), "__row").select(rows.columns)
    return out.drop("__row"), rounds


def _first_queries(left: DataFrame, few: int) -> int | None:
    """The last of the first queries that have no more than ``few`` rows in all; None if the very first has more."""
    counts = left.groupBy("q").agg(F.count("*").alias("n")).orderBy("q").limit(few)
    upto = counts.withColumn("upto", F.sum("n").over(W.orderBy("q").rowsBetween(W.unboundedPreceding, 0)))  # at most ``few`` rows
    return upto.where(F.col("upto") <= few).agg(F.max("q")).first()[0]


def _noted(taken: DataFrame, used: DataFrame, decided: DataFrame, won: DataFrame, keyed: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is taken, how often each key is, and which queries are decided, with a round's outcome."""
    fresh = keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return staged(taken.unionByName(won)), staged(used.unionByName(fresh).groupBy("key").agg(F.sum("n").alias("n"))), staged(decided.unionByName(done))


def _left(base: DataFrame, decided: DataFrame, used: DataFrame, cap_of: Column, names: list[str]) -> DataFrame:
    """Rows of undecided queries whose keys all have room: no row is moved while what is used up is small."""
    full = used.where(F.col("n") >= cap_of).select("key")
    left = base.join(decided, "q", "left_anti")
    for k in names:
        left = left.join(full.select(F.col("key").alias(k)), k, "left_anti")
    return left
