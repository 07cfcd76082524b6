"""Roll-ups: channels, representative ids, count drift, histograms, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.functions.text import unlock_rate
from curatrix.operators.select import capped_per_key


def channel_stats(links: DataFrame, channel: str, item: str, creator: str) -> DataFrame:
    """channel, item_count, creator_count, top_creator, top_count, top_share: of each channel's distinct items, how
    they spread over creators; ties for the top go to the smaller creator. Items with a null creator count as items alone."""
    items = links.select(channel, item, creator).distinct()
    per = items.where(F.col(creator).isNotNull()).groupBy(channel, creator).agg(F.count_distinct(item).alias("n"))
    totals = items.groupBy(channel).agg(F.count_distinct(item).alias("item_count"))
    top = per.groupBy(channel).agg(F.count("*").alias("creator_count"), F.min(F.struct((-F.col("n")).alias("least"), F.col(creator).alias("id"))).alias("top"))
    out = totals.join(top, channel, "left").select(channel, "item_count", F.coalesce("creator_count", F.lit(0)).alias("creator_count"), F.col("top.id").alias("top_creator"), F.coalesce(-F.col("top.least"), F.lit(0)).alias("top_count"))
    return out.withColumn("top_share", F.round(F.col("top_count") / F.col("item_count"), 4))


#: Shares and sizes that decide a channel's mode.
FOCUS, CROSS, CAPACITY, CREATORS = 0.7, 0.65, 8, 3


def channel_policy(stats: DataFrame, forced: Column | None = None) -> DataFrame:
    """Adds scope (the creator that a channel is about: a forced one, or one with most of its items), mode, capacity_ready,
    diversity_ready, eligible, status and priority. A channel about a creator needs no other ones."""
    kind = stats.schema["top_creator"].dataType
    scope = F.coalesce(F.lit(None).cast(kind) if forced is None else forced.cast(kind), F.when(F.col("top_share") >= FOCUS, F.col("top_creator")))
    out = stats.withColumn("scope", scope).withColumn("mode", F.when(F.col("scope").isNotNull(), "artist_focus").otherwise("cross_artist"))
    spread = (F.col("creator_count") >= CREATORS) & (F.col("top_share") <= CROSS)
    out = out.withColumn("capacity_ready", F.col("item_count") >= CAPACITY).withColumn("diversity_ready", F.col("scope").isNotNull() | spread)
    out = out.withColumn("eligible", F.col("capacity_ready") & F.col("diversity_ready")).withColumn("status", F.when(F.col("capacity_ready"), "published").otherwise("long_tail"))
    weight = F.when(F.col("scope").isNotNull(), F.lit(0.8)).otherwise(F.greatest(F.lit(0.4), 1 - 0.5 * F.col("top_share")))
    return out.withColumn("priority", F.log2(F.col("item_count") + 1) * weight)


def created_channels(channels: DataFrame, published: Column) -> DataFrame:
    """Channels with their policy, held back as candidates while what they are about isn't published."""
    ok = F.coalesce(published, F.lit(False))
    return channels.withColumn("status", F.when(ok, F.col("status")).otherwise("candidate")).withColumn("eligible", ok & F.col("eligible"))


def listed_channels(channels: DataFrame, key: str, limit: int = 180) -> DataFrame:
    """Published channels by priority, ties by key; 1 to 200 of them."""
    return channels.where("status = 'published'").orderBy(F.desc("priority"), key).limit(min(max(limit, 1), 200))


def representative_ids(counts: DataFrame, key: str, term: str, n: str, total: str, most: int = 5, least: int = 2, ratio: float = 0.1) -> DataFrame:
    """Per key the ``most`` frequent terms that are frequent enough, else its one most frequent term."""
    ok = (F.col(n) >= least) | (F.col(n) / F.col(total) >= ratio)
    w = W.partitionBy(key).orderBy(F.desc("__ok"), F.desc(n), term)
    ranked = counts.withColumn("__ok", ok.cast("int")).withColumn("__rn", F.row_number().over(w))
    kept = ranked.where(((F.col("__ok") == 1) & (F.col("__rn") <= most)) | (F.col("__rn") == 1))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", term))), lambda s: s[term]).alias("ids"))


def histogram(df: DataFrame, bucket: Column, width: int, bins: int) -> DataFrame:
    """bin, n for every bin, also the empty ones."""
    spark = df.sparkSession
    counts = df.select(F.floor(bucket / width).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return spark.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Value (missing: unknown) and count."""
    return df.groupBy(F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def count_drift(stored: DataFrame, key: str, count: str, actual: DataFrame) -> DataFrame:
    """key, stored, actual where a stored count differs; ``actual`` has key and n."""
    joined = stored.select(key, F.col(count).alias("stored")).join(actual.select(key, F.col("n").alias("actual")), key, "left")
    return joined.withColumn("actual", F.coalesce("actual", F.lit(0))).where(~F.col("stored").eqNullSafe(F.col("actual")))


def candidates(df: DataFrame, key: Column, label: str, item: str, least: int = 1, samples: int = 10) -> DataFrame:
    """key, n, label, aliases, sample: groups of labels with the same key; the most frequent spelling names the group."""
    rows = df.select(key.alias("key"), F.col(label).alias("label"), F.col(item).alias("item")).where("key <> ''").distinct()
    spellings = rows.groupBy("key", "label").agg(F.count("*").alias("k"))
    names = spellings.groupBy("key").agg(F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("top"), F.array_sort(F.collect_set("label")).alias("aliases"))
    items = rows.select("key", "item").distinct()
    rank = F.row_number().over(W.partitionBy("key").orderBy("item"))
    sized = items.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sample = items.withColumn("rn", rank).where(F.col("rn") <= samples).groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("sample"))
    return sized.join(names, "key").join(sample, "key").select("key", "n", F.col("top.label").alias("label"), "aliases", "sample")


def thresholds_met(metrics: DataFrame, key: str, definitions: DataFrame) -> DataFrame:
    """key, achievement: metrics are columns; definitions (achievement, metric, threshold) are a short fixed table."""
    names = [c for c in metrics.columns if c != key]
    long = metrics.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in names])).alias("m")).select(key, "m.metric", "m.value")
    return long.join(definitions, "metric").where(F.col("value") >= F.col("threshold")).select(key, "achievement")


def progress(value: Column, target: Column) -> Column:
    """Percent of the target, clamped."""
    return F.when(target > 0, F.round(100.0 * F.least(F.greatest(value, F.lit(0)), target) / target, 2)).otherwise(0.0)


def library_stats(log: DataFrame, user: str, kind: str, item: Column, favorite: str = "favorite", history: str = "history") -> DataFrame:
    """user, favorites, history (distinct items of each kind), views (all rows of the history)."""
    of = lambda k: F.count_distinct(F.when(F.col(kind) == k, item))
    return log.groupBy(user).agg(of(favorite).alias("favorites"), of(history).alias("history"), F.count_if(F.col(kind) == history).alias("views"))


def achievement_items(users: DataFrame, user: str, value: Column, target: int) -> DataFrame:
    """user, current (at most the target), target, unlocked, percent, and how many of all users have it; a null value is 0."""
    current = F.greatest(F.least(F.coalesce(value, F.lit(0)), F.lit(target)), F.lit(0)).cast("long")
    rows = users.select(user, current.alias("current"), F.lit(target).cast("long").alias("target")).withColumn("unlocked", F.col("current") >= F.col("target"))
    # one row
    totals = rows.agg(F.count("*").alias("active"), F.count_if("unlocked").alias("n"))
    return rows.join(F.broadcast(totals), F.lit(True)).select(user, "current", "target", "unlocked", progress(F.col("current"), F.col("target")).alias("percent"), unlock_rate(F.col("n"), F.col("active")).alias("unlock_rate"))


def channel_sections(channels: DataFrame, channel: str, value: str, items: DataFrame, item: str, values: Column, most: int, *order: str) -> DataFrame:
    """The channel's column, item: the first ``most`` items by the order that have a channel's value among theirs."""
    long = items.select(*dict.fromkeys([item, *order]), F.explode(F.array_distinct(values)).alias(value))
    return capped_per_key(long.join(channels.select(channel, value).distinct(), value), [channel], most, *order, item).select(channel, item)


def review_audit(reviews: DataFrame, key: str, rejected: Column, selected: Column, undecided: Column, scope: DataFrame) -> DataFrame:
    """One row: rows, ids and repeated ones of a review, how they were decided, and keys of ``scope`` that it lacks."""
    counts = reviews.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), *[F.count_if(c).alias(n) for n, c in (("undecided", undecided), ("selected", selected), ("rejected", rejected))])
    missing = scope.select(key).join(reviews.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    # one row each
    return counts.join(F.broadcast(missing), F.lit(True)).withColumn("repeated", F.col("rows") - F.col("ids"))
