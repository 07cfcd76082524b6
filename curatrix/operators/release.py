"""Releases: terms and channels promoted together, accounts brought up to a schema, queues of work, touched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.catalogue import ACHIEVEMENTS, DEFAULT_ACHIEVEMENT
from curatrix.functions.text import document_id
from curatrix.operators.checks import is_visible_artist


def touched(before: DataFrame, after: DataFrame, key: str, at: Column, stamp: str = "updated_at") -> DataFrame:
    """``after`` with its time stamp set to ``at`` in rows that differ from ``before`` or are new."""
    fields = [c for c in after.columns if c not in (key, stamp)]
    old = before.select(key, F.struct(*fields).alias("__old"), F.col(stamp).alias("__at"))
    joined = after.drop(stamp).join(old, key, "left")
    same = F.col("__old").isNotNull() & F.struct(*fields).eqNullSafe(F.col("__old"))
    return joined.select(key, *fields, F.when(same, F.col("__at")).otherwise(at).alias(stamp))


def promoted_terms(terms: DataFrame) -> DataFrame:
    """Terms with reviewed drafts published; ``released`` marks them."""
    draft = (F.col("review_status") == "reviewed") & (F.col("publish_status") == "draft")
    return terms.withColumn("released", F.coalesce(draft, F.lit(False))).withColumn("publish_status", F.when(F.col("released"), "published").otherwise(F.col("publish_status")))


def promoted_channels(channels: DataFrame, terms: DataFrame) -> DataFrame:
    """Channels of released terms published: by their capacity, and featured if diverse as well; others as they are."""
    released = terms.where("released").select(F.col("_id").alias("query_value"), F.lit(True).alias("__released"))
    rows = channels.join(released, "query_value", "left")
    now = (F.col("kind") == "controlled_term") & F.coalesce("__released", F.lit(False))
    status = F.when(now, F.when(F.col("capacity_ready"), "published").otherwise("long_tail")).otherwise(F.col("channel_status"))
    featured = F.when(now, F.col("capacity_ready") & F.col("diversity_ready")).otherwise(F.col("auto_feature_eligible"))
    return rows.withColumn("channel_status", status).withColumn("auto_feature_eligible", featured).select(*channels.columns)


def released_works(works: DataFrame, patches: DataFrame, key: str, version: str) -> DataFrame:
    """Works with their patch's fields and the release's version. A work without a patch stops the release: the job that
    reads it ends in an error that names the work. ``unpatched`` lists them beforehand."""
    fields = [c for c in patches.columns if c not in (key, "previous")]
    joined = works.drop("previous", "changed", *fields).join(patches.select(key, *fields, F.lit(True).alias("__patched")), key, "left")
    stop = F.raise_error(F.concat(F.lit("no patch for "), F.coalesce(F.col(key).cast("string"), F.lit("a work without a key"))))
    return joined.withColumn("release_version", F.when(F.col("__patched"), F.lit(version)).otherwise(stop)).drop("__patched")


def unpatched(works: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    return works.select(key).join(patches.select(key), key, "left_anti")


def owned_achievements(metrics: DataFrame, owned: DataFrame, user: str = "user_id") -> DataFrame:
    """user, achievement_id, is_new: what active users own and what their metrics earn now. ``metrics`` has a row per active
    user with a column per metric, ``owned`` (user, achievement_id) what is on record; unknown ids are left out."""
    automatic = [F.when(F.lit(True) if grant == "default" else F.coalesce(F.col(metric) >= least, F.lit(False)), name) for name, (_, grant, metric, least, _) in ACHIEVEMENTS.items() if grant == "default" or grant == "automatic"]
    earned = metrics.select(user, F.explode(F.filter(F.array(*automatic), lambda x: x.isNotNull())).alias("achievement_id"))
    known = owned.where(F.col("achievement_id").isin(*ACHIEVEMENTS)).join(metrics.select(user), user, "left_semi").select(user, "achievement_id").distinct()
    return known.withColumn("is_new", F.lit(False)).unionByName(earned.join(known, [user, "achievement_id"], "left_anti").withColumn("is_new", F.lit(True)))


def account_updates(users: DataFrame, owned: DataFrame, version: int, user: str = "user_id") -> DataFrame:
    """user, equipped_title_id of accounts that must change: not registered, of another version, or showing a title they
    don't own (then the default one)."""
    titles = owned.groupBy(user).agg(F.collect_set("achievement_id").alias("__owned"))
    rows = users.join(titles, user, "left")
    title = F.when(F.array_contains(F.coalesce("__owned", F.array().cast("array<string>")), F.col("equipped_title_id")), F.col("equipped_title_id")).otherwise(DEFAULT_ACHIEVEMENT)
    same = F.col("registered").eqNullSafe(F.lit(True)) & F.col("equipped_title_id").eqNullSafe(title) & F.col("schema_version").eqNullSafe(F.lit(version))
    return rows.where(~same).select(user, title.alias("equipped_title_id"))


def achievement_document(user: Column | str, achievement_id: Column | str) -> Column:
    return F.concat(F.lit("ach_"), document_id(user, achievement_id))


def portrait_queue(artists: DataFrame, governance: DataFrame, links: DataFrame) -> DataFrame:
    """Visible creators with what governance knows of them, their linked works counted, whether a portrait may be searched
    for (verified or provisional persons only), and a priority by works. ``links`` has artist_id and artwork_id."""
    counts = links.select("artist_id", "artwork_id").distinct().groupBy(F.col("artist_id").alias("_id")).agg(F.count("*").alias("linked_artwork_count"))
    ruled = governance.select("_id", F.col("entity_type").alias("__type"), F.col("identity_status").alias("__identity"), F.col("research_priority").alias("__priority"))
    rows = artists.where(is_visible_artist()).join(ruled, "_id", "left").join(counts, "_id", "left")
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit("unresolved"))
    rows = rows.withColumn("entity_type", first("__type", "entity_type")).withColumn("identity_status", first("__identity", "identity_status")).withColumn("linked_artwork_count", F.coalesce("linked_artwork_count", F.lit(0)))
    works = F.coalesce(F.nullif("artwork_count", F.lit(0)), "linked_artwork_count")
    priority = F.when(F.col("__priority").rlike("^P[0-2]$"), F.col("__priority")).when(works >= 50, "P0").when(works >= 10, "P1").otherwise("P2")
    status = F.when(F.col("entity_type") != "person", "non_person_entity").when(~F.col("identity_status").isin("verified", "provisional"), "identity_unresolved").otherwise("pending")
    return rows.select("_id", "entity_type", "identity_status", works.cast("long").alias("artwork_count"), "linked_artwork_count", (status == "pending").alias("search_eligible"), status.alias("final_status"), priority.alias("target_priority"))
