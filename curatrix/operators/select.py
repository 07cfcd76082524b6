"""Choosing rows: ranks per key, round robin, samples, quotas, numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.sources.files import staged


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return capped_per_key(df, keys, 1, *order)


def capped_per_key(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def round_robin(df: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """One row of each key per round, keys in the order in which they are first seen. At most ``limit`` rows of a
    key can be taken, so the rest never reaches the sort; adds ``position``."""
    w = W.partitionBy(key).orderBy(order)
    ranked = df.withColumn("__round", F.row_number().over(w)).withColumn("__seen", F.first(order).over(w)).where(F.col("__round") <= limit)
    taken = ranked.orderBy("__round", "__seen").limit(limit)
    # at most ``limit`` rows are numbered in one task
    return taken.withColumn("position", F.row_number().over(W.orderBy("__round", "__seen"))).drop("__round", "__seen")


def stratified(df: DataFrame, cohort: str, key: str, order: str, per_cohort: int) -> DataFrame:
    """Round robin by key inside each cohort, the first ``per_cohort`` of each."""
    w = W.partitionBy(cohort, key).orderBy(order)
    ranked = df.withColumn("__round", F.row_number().over(w)).withColumn("__seen", F.first(order).over(w)).where(F.col("__round") <= per_cohort)
    rank = F.row_number().over(W.partitionBy(cohort).orderBy("__round", "__seen"))
    return ranked.withColumn("cohort_rank", rank).where(F.col("cohort_rank") <= per_cohort).drop("__round", "__seen")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A repeatable random order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def diversified(df: DataFrame, key: str, order: str, seed: int) -> DataFrame:
    """Round robin by key with the keys in another random order in each round; adds ``__round`` and sorts."""
    ranked = df.withColumn("__round", F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(F.col(order), F.lit(seed)), order)))
    return ranked.orderBy("__round", F.xxhash64("__round", F.col(key), F.lit(seed)), key)


def greedy_under_caps(df: DataFrame, group: str, caps: dict[str, int], *order: str) -> DataFrame:
    """Rows of each group taken in order while none of their keys has reached its cap; null is a group, and a key, like
    any other. ``order`` must be total. Rows are numbered once and decided in rounds (``matching``), each of which reads
    and writes only those that are still undecided."""
    from curatrix.operators.matching import taken_in_turn

    keys = {name: ([group, name], cap) for name, cap in caps.items()}
    return taken_in_turn(numbered(df, *order).withColumnRenamed("number", "__turn"), "__turn", ["__turn"], keys)[0].drop("__turn")


def numbered(df: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """Adds ``number``: dense numbers in the order given. Rows are sorted by range over all tasks and written once;
    each range then adds the number of rows before it, so that no task sees all rows."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = staged(sorted_.withColumn("__at", F.monotonically_increasing_id()))
    low = (1 << 33) - 1
    local = local.withColumn("__part", F.shiftright("__at", 33)).withColumn("__row", F.col("__at").bitwiseAND(F.lit(low)))
    counts = local.groupBy("__part").agg(F.count("*").alias("__n"))
    # one row per range of the sort, so as few as the job has partitions
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(before.drop("__n"), "__part").withColumn("number", F.col("__before") + F.col("__row") + F.lit(start)).drop("__at", "__part", "__row", "__before")


def islands(df: DataFrame, key: str, width: int = 1 << 20) -> DataFrame:
    """Ranges of consecutive whole numbers: first, last, size. Ranges are found inside blocks of ``width`` numbers and
    sewn together over block borders, where only ranges that touch a border take part."""
    ids = df.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    block = F.floor(F.col("id") / width)
    local = ids.withColumn("block", block).withColumn("run", F.col("id") - F.row_number().over(W.partitionBy("block").orderBy("id"))).groupBy("block", "run").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    closed = local.where((F.col("first") % width != 0) & ((F.col("last") + 1) % width != 0)).select("first", "last")
    edge = local.where((F.col("first") % width == 0) | ((F.col("last") + 1) % width == 0))
    # at most two ranges per block
    w = W.orderBy("first")
    new = F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)
    sewn = edge.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last")
    return closed.unionByName(sewn).withColumn("size", F.col("last") - F.col("first") + 1)


def page(df: DataFrame, *order: Column | str, skip: int = 0, size: int = 20) -> DataFrame:
    """One page; a sort with a limit keeps only skip + size rows per task."""
    return df.orderBy(*order).offset(skip).limit(size)


def page_with_more(df: DataFrame, *order: Column | str, skip: int = 0, size: int = 20) -> DataFrame:
    """One page with ``has_more``: one row more is fetched and counted, not returned."""
    taken = df.orderBy(*order).offset(skip).limit(size + 1)
    w = W.orderBy(*order)
    return taken.withColumn("__rn", F.row_number().over(w)).withColumn("has_more", F.count("*").over(W.partitionBy()) > size).where(F.col("__rn") <= size).drop("__rn")


def no_repeat_sections(df: DataFrame, sections: list[str], section: str, item: str, order: str, limit: int) -> DataFrame:
    """Sections in the given order, each taking its first ``limit`` items that no earlier one took. One job per
    section of a short list; what is taken is at most ``limit`` rows each."""
    taken = None
    for name in sections:
        rows = first_per_key(df.where(F.col(section) == name), [item], order, *[c for c in df.columns if c not in (item, order)])
        if taken is not None:
            rows = rows.join(taken.select(item), item, "left_anti")
        rows = staged(rows.orderBy(order, item).limit(limit).select(df.columns))
        taken = rows if taken is None else taken.unionByName(rows)
    return taken
