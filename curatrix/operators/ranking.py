"""Ranked choice over candidates: text relevance, per-owner short lists with overrides, signal routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bm25(docs: DataFrame, key: str, text: str, query: list[str], boosts: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score by BM25 over whole texts. Only the query's words are counted per document and shuffled; lengths and
    document frequencies are one aggregate."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    wanted = list(dict.fromkeys(w.lower() for w in query))
    counted = docs.select(F.col(key), words.alias("w")).select(key, F.size("w").alias("n"), *[(F.size("w") - F.size(F.array_remove("w", q))).alias(f"f{i}") for i, q in enumerate(wanted)])
    totals = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    scored = counted.where(" OR ".join(f"f{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(totals))  # one row
    norm = k1 * (1 - b + b * F.col("n") / F.col("mean"))
    parts = [F.lit((boosts or {}).get(q, 1.0)) * F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + norm) for i, q in enumerate(wanted)]
    return scored.select(key, F.round(sum(parts, F.lit(0.0)), 6).alias("score"))


def listing_score(title: Column, query: str, popularity: Column, derivative: Column) -> Column:
    """100 for each of the query's words in the title, the popularity, and 250 less for derivative works."""
    hits = sum((F.contains(F.lower(title), F.lit(t)).cast("int") for t in dict.fromkeys(query.lower().split())), F.lit(0))
    return 100 * hits + F.coalesce(popularity, F.lit(0)) - F.when(derivative, 250).otherwise(0)


def short_lists(candidates: DataFrame, owner: str, file_key: str, score: str, tie: str, external: Column, most: int = 3) -> DataFrame:
    """Per owner the best ``most`` candidates, a file used once over all owners (where it scores best). An owner
    with none but internal ones gets its best external one in the last place. Adds ``rank``."""
    once = F.row_number().over(W.partitionBy(file_key).orderBy(F.desc(score), tie))
    own = candidates.withColumn("__once", once).where("__once = 1").drop("__once").withColumn("__ext", external)
    w = W.partitionBy(owner).orderBy(F.desc(score), tie)
    ranked = own.withColumn("rank", F.row_number().over(w))
    ranked = ranked.withColumn("__has", F.max(((F.col("rank") <= most) & F.col("__ext")).cast("int")).over(W.partitionBy(owner)))
    ranked = ranked.withColumn("__next", F.min(F.when(F.col("__ext"), F.col("rank"))).over(W.partitionBy(owner)))
    swap = (F.col("__has") == 0) & F.col("__next").isNotNull()
    kept = ranked.where(F.when(swap, (F.col("rank") < most) | (F.col("rank") == F.col("__next"))).otherwise(F.col("rank") <= most))
    return kept.withColumn("rank", F.least(F.col("rank"), F.lit(most))).drop("__ext", "__has", "__next")


def decisions(ranked: DataFrame, owner: str, candidate: str, rank: str, overrides: DataFrame) -> DataFrame:
    """owner, selected, alternate: the override if there is one, else the best; the alternate is the best other one.
    ``overrides`` has owner and override."""
    joined = ranked.join(overrides, owner, "left")
    ordered = joined.withColumn("__first", (F.col(candidate) == F.col("override")).cast("int"))
    w = W.partitionBy(owner).orderBy(F.desc_nulls_last("__first"), rank)
    places = ordered.withColumn("__rn", F.row_number().over(w)).where("__rn <= 2")
    return places.groupBy(owner).agg(F.max(F.when(F.col("__rn") == 1, F.col(candidate))).alias("selected"), F.max(F.when(F.col("__rn") == 2, F.col(candidate))).alias("alternate"))


def signal_assignments(queue: DataFrame, label: str, item: str, index: DataFrame, ignored: list[str], creators: DataFrame) -> DataFrame:
    """item, label, outcome, signal_id: labels that name a creator of the item, or are ignored, are set aside; an alias
    of one signal links; all others stay unresolved. ``creators`` has item and creator_label."""
    plain = F.lower(F.trim(F.col(label)))
    own = creators.select(item, F.lower("creator_label").alias("__alias"), F.lit(True).alias("__own")).distinct()
    joined = queue.withColumn("__alias", plain).join(own, [item, "__alias"], "left").join(index.withColumnRenamed("alias", "__alias"), "__alias", "left")
    outcome = F.when(F.col("__own"), "creator").when(F.col("__alias").isin(ignored), "ignored").when(F.size("ids") == 1, "linked").otherwise("unresolved")
    return joined.select(item, label, outcome.alias("outcome"), F.when(outcome == "linked", F.element_at("ids", 1)).alias("signal_id"))


def recounted_channels(channels: DataFrame, channel: str, field: str, value: str, items: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """channel, n: items whose array named by the channel's field holds its value; one exploded pass for all channels."""
    long = items.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).alias("values")) for a in arrays])).alias("e")).select(key, "e.field", F.explode("e.values").alias("value")).distinct()
    counts = long.groupBy(F.col("field").alias(field), F.col("value").alias(value)).agg(F.count("*").alias("n"))
    return channels.join(counts, [field, value], "left").select(channel, F.coalesce("n", F.lit(0)).alias("n"))


def batches(rows: DataFrame, *order: str, size: int) -> DataFrame:
    """Adds ``batch`` and ``place`` in it by the order."""
    from curatrix.operators.select import numbered

    return numbered(rows, *order).withColumn("batch", F.floor(F.col("number") / size)).withColumn("place", F.col("number") % size).drop("number")
