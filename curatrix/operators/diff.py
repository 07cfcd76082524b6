"""Comparing states: preflight, transitions, reconciliation, deduplication, folding of patches, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def preflight(current: DataFrame, previous: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, state: applied (current is the target), pending (it is the previous state), mismatch (neither)."""
    fields = [c for c in target.columns if c != key]

    def row(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*fields).alias(name))

    joined = row(current, "c").join(row(previous, "p"), key, "full_outer").join(row(target, "t"), key, "full_outer")
    state = F.when(F.col("c").eqNullSafe(F.col("t")), "applied").when(F.col("c").eqNullSafe(F.col("p")), "pending").otherwise("mismatch")
    return joined.select(key, state.alias("state"))


def transition(current: DataFrame, previous: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, problem: unexpected ids (in neither state), and missing ones (in both but not there)."""
    # ids are moved once and nothing is sent out: long ids shrink so much in a shuffle that Spark takes their side for small
    states = (current, previous, target)
    tagged = reduce(lambda a, b: a.unionByName(b), [d.select(key, *[F.lit(n == m).alias(n) for n in "cpt"]) for m, d in zip("cpt", states, strict=True)])
    seen = tagged.groupBy(key).agg(*[F.max(n).alias(n) for n in "cpt"])
    known = F.col(key).isNotNull()  # a missing id is none of another state
    problem = F.when(F.expr("c") & ~(known & F.expr("p OR t")), "unexpected").when(known & F.expr("NOT c AND p AND t"), "missing")
    return seen.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def reconciled(baseline: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: added or removed."""
    a, b = baseline.select(*keys).distinct(), candidate.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and the names of the fields that differ, null-safe; rows of both sides only."""
    fields = [c for c in after.columns if c != key]
    joined = before.alias("a").join(after.alias("b"), key)
    names = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in fields]), lambda x: x.isNotNull())
    return joined.select(key, names.alias("changed")).where(F.size("changed") > 0)


def metric_deltas(previous: DataFrame, current: DataFrame) -> DataFrame:
    """metric, before, after, delta of two reports of one row each."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("double") for c in df.columns]))).alias("metric", name))

    both = long(previous, "before").join(long(current, "after"), "metric", "full_outer")
    return both.withColumn("delta", F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))


def union_first_wins(key: str, *parts: DataFrame) -> DataFrame:
    """Rows of all parts, of each key that of the earliest part (and there, the smallest row)."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    rest = [c for c in parts[0].columns if c != key]
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy("__part", *rest))).where("__rn = 1").drop("__rn", "__part")


def dedupe_first(rows: DataFrame, key: str, order: str, known: DataFrame) -> DataFrame:
    """Of each key the first row by ``order`` and then the other columns, and only keys that ``known`` (one column, key)
    doesn't hold. Missing keys stay. Tasks keep one row per key before anything is shuffled."""
    keyed, bare = rows.where(F.col(key) != ""), rows.where(F.coalesce(F.col(key), F.lit("")) == "")
    rest = [c for c in rows.columns if c not in (key, order)]
    first = keyed.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__first")).select(key, "__first.*")
    return first.join(known.select(key).distinct(), key, "left_anti").select(rows.columns).unionByName(bare)


def folded_patches(patches: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of every field the value of the last patch that has one."""
    fields = [c for c in patches.columns if c not in (key, order)]
    return patches.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields])


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: one row per rule that a row breaks; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def failed_reasons(rules: dict[str, Column]) -> Column:
    """Array of the names of failed predicates, in their order."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]), lambda x: x.isNotNull())


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys without a parent, with the number of rows."""
    return rows.where(F.col(column).isNotNull()).join(parents, F.col(column) == F.col(parent_key), "left_anti").groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))


def conflicting_aliases(df: DataFrame, key: str, alias: Column, allowed: list[str] = ()) -> DataFrame:
    """alias, n: aliases that more than one record claims."""
    rows = df.select(F.col(key).alias("id"), F.lower(F.trim(alias)).alias("alias")).where(F.col("alias") != "")
    out = rows.groupBy("alias").agg(F.count_distinct("id").alias("n")).where("n > 1")
    return out.where(~F.col("alias").isin(list(allowed))) if allowed else out
