"""Queries of the recommendation build: labels routed to signals, patches of works, channels of every kind, its report; and of images kept
in several places."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import functions as F

from curatrix.operators import images
from curatrix.operators import recommend as R
from curatrix.plans.registry import registry
from curatrix.plans.serving import _BUCKET
from curatrix.sources.control import control_table
from curatrix.sources.files import table

QUERIES, SQL, query = registry()

#: Names under which words of the parts' names stand for signals; "large" and "plate" stand for two.
_ALIASES = [
    ("signal-palette-red", "red"),
    ("signal-palette-blue", "blue"),
    ("signal-theme-modernism-pioneer", "new"),
    ("signal-theme-famous-places", "old"),
    ("signal-setting-nature", "cold"),
    ("signal-setting-nature", "large"),
    ("signal-setting-garden", "large"),
    ("signal-design-study", "plate"),
    ("signal-design-general", "plate"),
    ("signal-motif-goldfish", " ring "),
]


def _inputs(spark, d):
    """Parts as works by their suppliers, suppliers as creators, part types and articles as terms, names' words as labels."""
    parts = table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("string")).withColumn("words", F.split("p_name", " "))
    # sets of numbers, which become ids when they are whole
    made = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("made_by"))
    made = made.select("p_partkey", F.transform("made_by", lambda k: F.concat(F.lit("supplier-"), k.cast("string"))).alias("artist_ids"))
    first, article = F.element_at("words", 1), F.concat(F.lit("medium-"), F.element_at("words", -1))
    works = parts.join(made, "p_partkey", "left").select(
        "id",
        "artist_ids",
        F.array("p_brand").alias("artist_labels"),
        F.when(F.col("p_size") > 44, F.concat(F.lit("House of "), first)).when(F.col("p_size") == 1, F.concat(F.lit("Unknown, "), first)).alias("artist"),
        F.when(F.col("p_size") % 3 > 0, F.array(F.concat(F.lit("subject-"), F.lower("p_type")))).alias("classification_ids"),
        F.array(article).alias("tag_ids"),
        F.array(article, F.concat(F.lit("subject-"), F.lower("p_type"))).alias("recommendation_term_ids"),
    )
    sources = parts.select("id", F.when(F.col("p_size") % 7 == 0, "draft").otherwise("published").alias("status"), F.when(F.col("p_size") > 4, F.concat("p_name", F.lit(".jpg"))).alias("image"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"))
    kind = F.when(F.col("s_nationkey") % 5 == 0, "workshop").otherwise("person")
    creators = table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.col("s_name"), F.when(F.col("s_acctbal") > 5000, "hot")).alias("names"), kind.alias("entity_type"), F.when(F.col("s_acctbal") < 0, "candidate").otherwise("reviewed").alias("review_status"))
    scopes = F.when(F.col("label_zh") != "rod", F.array(F.lit("search"), F.lit("recommendation")))
    terms = works.select(F.explode("recommendation_term_ids").alias("_id")).distinct().withColumn("label_zh", F.substring_index("_id", "-", -1))
    terms = terms.withColumn("usage_scopes", scopes).withColumn("publish_status", F.when(F.col("label_zh") == "gizmo", "draft").otherwise("published"))
    catalogue = R.with_aliases(R.signal_catalogue(control_table(spark, "recommendation_signals")), spark.createDataFrame(_ALIASES, "id string, alias string"))
    queue = parts.select(F.col("id").alias("work_id"), F.explode("words").alias("source_text"))
    return works, sources, creators, terms, catalogue, queue, ["artist"]


def _values() -> str:
    lines = resources.files("curatrix.data").joinpath("recommendation_signals.csv").read_text("utf-8").splitlines()[2:]
    return ", ".join(f"('{i}', '{t}', '{k}')" for i, t, k in csv.reader(lines))


_ROUTED = f"""
    cat(sid, title, type) AS (VALUES {_values()}), alias(sid, label) AS (VALUES {', '.join(f"('{i}', '{a.strip()}')" for i, a in _ALIASES)}),
    made AS (SELECT DISTINCT l_partkey AS p_partkey, 'supplier-' || l_suppkey AS cid FROM lineitem), who AS (SELECT 'supplier-' || s_suppkey AS cid, s_name AS name, CASE WHEN s_acctbal > 5000 THEN 'hot' END AS other, s_nationkey % 5 <> 0 AND s_acctbal >= 0 AS person FROM supplier),
    names AS (SELECT cid, name AS label FROM who UNION SELECT cid, other FROM who WHERE other IS NOT NULL),
    w AS (SELECT *, CAST(p_partkey AS VARCHAR) AS id, string_split(p_name, ' ') AS words, CASE WHEN p_size > 44 THEN 'House of ' || split_part(p_name, ' ', 1) END AS display FROM part),
    own AS (SELECT p_partkey, p_brand AS label FROM w UNION SELECT p_partkey, display FROM w WHERE display IS NOT NULL UNION SELECT p_partkey, label FROM made JOIN names USING (cid)),
    q AS (SELECT p_partkey, unnest(words) AS t FROM w),
    k AS (SELECT p_partkey, t, t IN (SELECT label FROM names) OR EXISTS (SELECT 1 FROM own WHERE own.p_partkey = q.p_partkey AND len(t) >= 2 AND (contains(own.label, t) OR contains(t, own.label))) AS named, (SELECT list(sid ORDER BY sid) FROM alias WHERE label = t) AS ids FROM q),
    routed AS (SELECT CAST(p_partkey AS VARCHAR) AS work_id, p_partkey, t AS source_text, CASE WHEN named THEN 'creator' WHEN len(ids) = 1 THEN 'linked' WHEN len(ids) > 1 THEN 'ambiguous_signal_alias' ELSE 'unmapped_signal_label' END AS outcome, ids FROM k)"""
_PATCHED = f"""{_ROUTED},
    sig AS (SELECT p_partkey, list(DISTINCT ids[1] ORDER BY ids[1]) AS signals FROM routed WHERE outcome = 'linked' GROUP BY 1),
    patched AS (
        SELECT w.*, signals, {_BUCKET} AS bucket,
               list_filter([CASE WHEN p_size % 7 = 0 THEN 'not_published' END, CASE WHEN p_size <= 4 THEN 'missing_image' END], lambda x: x IS NOT NULL) AS reasons,
               round(0.45 * CAST(p_size > 4 AS INTEGER) + 0.15 + 0.15 * CAST(p_partkey IN (SELECT p_partkey FROM made) AS INTEGER) + 0.15 + 0.1 * CAST(p_size % 2 = 0 AS INTEGER), 2)::DOUBLE AS quality
        FROM w LEFT JOIN sig USING (p_partkey)
    )"""
_CHANNELS = f"""{_PATCHED},
    e AS (SELECT * FROM patched WHERE len(reasons) = 0),
    term AS (SELECT DISTINCT 'subject-' || lower(p_type) AS tid, lower(p_type) AS title, TRUE AS shown FROM part UNION SELECT DISTINCT 'medium-' || words[-1], words[-1], words[-1] <> 'gizmo' FROM w WHERE words[-1] <> 'rod'),
    cls AS (SELECT p_partkey, 'subject-' || lower(p_type) AS tid FROM e WHERE p_size % 3 > 0),
    rec AS (SELECT p_partkey, 'subject-' || lower(p_type) AS tid FROM e UNION SELECT p_partkey, 'medium-' || words[-1] FROM e),
    filed AS (
        SELECT 'signal:' || sid AS channel_key, p_partkey FROM (SELECT unnest(signals) AS sid, p_partkey FROM e)
        UNION ALL SELECT 'artist:' || cid, p_partkey FROM e JOIN made USING (p_partkey)
        UNION ALL SELECT 'term:' || tid, p_partkey FROM cls UNION ALL SELECT 'term:' || tid, p_partkey FROM rec WHERE tid NOT IN (SELECT tid FROM cls)
    ),
    tops AS (SELECT channel_key, cid, count(*) AS n FROM filed JOIN made USING (p_partkey) GROUP BY ALL),
    top AS (SELECT channel_key, count(*) AS creators, arg_min(cid, (-n, cid)) AS top_creator, max(n) AS top_count FROM tops GROUP BY 1),
    sizes AS (SELECT channel_key, count(*) AS items FROM filed GROUP BY 1),
    subject AS (
        SELECT 'signal:' || sid AS channel_key, title, 'signal' AS kind, 'recommendation_signal_ids' AS query_field, sid AS query_value, NULL AS forced, TRUE AS shown FROM cat
        UNION ALL SELECT 'artist:' || cid, name, 'artist', 'artist_ids', cid, cid, TRUE FROM who WHERE person AND 'artist:' || cid IN (SELECT channel_key FROM sizes)
        UNION ALL SELECT 'term:' || tid, title, 'controlled_term', CASE WHEN tid IN (SELECT tid FROM cls) THEN 'classification_ids' ELSE 'tag_ids' END, tid, NULL, shown FROM term WHERE 'term:' || tid IN (SELECT channel_key FROM sizes)
    ),
    c AS (SELECT subject.*, CAST(coalesce(items, 0) AS BIGINT) AS item_count, CAST(coalesce(creators, 0) AS BIGINT) AS creator_count, top_creator, CAST(coalesce(top_count, 0) AS BIGINT) AS top_count, coalesce(round(top_count / items, 4), 0)::DOUBLE AS top_share FROM subject LEFT JOIN sizes USING (channel_key) LEFT JOIN top USING (channel_key)),
    s AS (SELECT *, coalesce(forced, CASE WHEN top_share >= 0.7 THEN top_creator END) AS scope FROM c),
    channels AS (
        SELECT channel_key, title, kind, query_field, query_value, item_count, creator_count, top_creator, top_count, top_share, scope, CASE WHEN scope IS NULL THEN 'cross_artist' ELSE 'artist_focus' END AS mode,
               CASE WHEN NOT shown THEN 'candidate' WHEN item_count >= 8 THEN 'published' ELSE 'long_tail' END AS status,
               shown AND item_count >= 8 AND (scope IS NOT NULL OR (creator_count >= 3 AND top_share <= 0.65)) AS eligible,
               CASE WHEN item_count = 0 THEN 0 ELSE round(log2(item_count + 1) * CASE WHEN scope IS NULL THEN greatest(0.4, 1 - 0.5 * top_share) ELSE 0.8 END, 4) END::DOUBLE AS priority
        FROM s
    )"""


@query(f"WITH {_ROUTED} SELECT work_id, source_text, outcome, CASE WHEN outcome = 'linked' THEN ids[1] END AS signal_id, coalesce(array_to_string(ids, ','), '') AS candidates FROM routed")
def recommendation_labels(spark, d):
    """Every label of every work: names of creators set aside, labels of one signal linked, all others for review."""
    works, _, creators, _, catalogue, queue, written = _inputs(spark, d)
    return R.routes(works, creators, catalogue, queue, written).select("work_id", "source_text", "outcome", "signal_id", F.array_join("candidate_signal_ids", ",").alias("candidates"))


@query(f"WITH {_PATCHED} SELECT id, coalesce(array_to_string(signals, ','), '') AS signals, array_to_string(reasons, ',') AS reasons, CASE WHEN len(reasons) > 0 THEN 'ineligible' ELSE 'eligible' END AS status, quality, CAST(bucket AS BIGINT) AS bucket FROM patched")
def recommendation_patches(spark, d):
    """What the build writes to each work."""
    works, sources, creators, _, catalogue, queue, written = _inputs(spark, d)
    return R.patches(works, sources, R.signal_links(R.routes(works, creators, catalogue, queue, written))).select("id", F.array_join("recommendation_signal_ids", ",").alias("signals"), F.array_join("reasons", ",").alias("reasons"), "status", "quality", "bucket")


@query(f"WITH {_CHANNELS} SELECT * FROM channels")
def recommendation_channels(spark, d):
    """All channels with their spread, policy and priority."""
    return R.built(*_inputs(spark, d)).channels


@query(
    f"""
    WITH {_CHANNELS}, st AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'ineligible' ELSE 'eligible' END AS status FROM patched)
    SELECT 'signals by type' AS section, type AS name, count(*) AS n FROM cat GROUP BY type
    UNION ALL SELECT 'labels by outcome', outcome, count(*) FROM routed GROUP BY outcome
    UNION ALL SELECT 'works', 'with signals', count(*) FROM patched WHERE len(signals) > 0
    UNION ALL SELECT 'works by status', status, count(*) FROM st GROUP BY status
    UNION ALL SELECT 'works by reason', r, count(*) FROM (SELECT unnest(reasons) AS r FROM patched) GROUP BY r
    UNION ALL SELECT 'channels by kind', kind, count(*) FROM channels GROUP BY kind
    UNION ALL SELECT 'channels by status', status, count(*) FROM channels GROUP BY status
    UNION ALL SELECT 'channels by field', query_field, count(*) FROM channels GROUP BY query_field
    UNION ALL SELECT 'channels by mode', mode, count(*) FROM channels GROUP BY mode
    UNION ALL SELECT 'channels', 'eligible', count(*) FROM channels WHERE eligible
    UNION ALL SELECT 'works by bucket', CAST(b AS VARCHAR), (SELECT count(*) FROM patched WHERE bucket // 100 = b) FROM range(100) t(b)
    UNION ALL SELECT 'validation', 'unmapped labels', count(*) FROM routed WHERE outcome LIKE '%signal%'
    UNION ALL SELECT 'validation', 'repeated links', count(*) FROM (SELECT work_id, source_text FROM routed WHERE outcome = 'linked' GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'validation', name, 0 FROM (VALUES ('unknown signals'), ('bad buckets'), ('works without a source'), ('sources without a work')) v(name)
    """
)
def recommendation_report(spark, d):
    """Counts of a whole build and what its checks found."""
    return R.built(*_inputs(spark, d)).report


_IMAGES = """
    i AS (SELECT p_partkey AS id, 'work-' || p_brand AS work_id, sha256(p_name) AS stored, CASE WHEN p_size <= 45 THEN sha256(CASE WHEN p_size < 5 THEN p_type ELSE p_name END) END AS kept, length(p_name) AS bytes, CASE WHEN p_size <= 45 THEN length(CASE WHEN p_size < 5 THEN p_type ELSE p_name END) END AS local_bytes, 'https://source/' || p_brand AS source_url FROM part),
    x AS (SELECT 'https://source/' || p_brand AS source_url, min(p_name) AS name FROM part GROUP BY 1),
    m AS (SELECT id, work_id, source_url, CAST(bytes AS BIGINT) AS storage_bytes, CAST(local_bytes AS BIGINT) AS local_bytes, CAST(length(name) AS BIGINT) AS expected_bytes, coalesce(stored = kept, false) AS storage_matches_local, stored = sha256(name) AS storage_matches_expected, coalesce(kept = sha256(name), false) AS local_matches_expected FROM i JOIN x USING (source_url))"""


def _images(spark, d):
    """Parts' names as stored images, copies of them kept in a folder (some wrong, some missing), and what brands' pages show."""
    parts = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
    work = F.concat(F.lit("work-"), "p_brand")
    hashed = lambda df, key, text: df.select(key, F.length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("hash"))
    local = hashed(parts.where("p_size <= 45"), F.col("id"), F.when(F.col("p_size") < 5, F.col("p_type")).otherwise(F.col("p_name")))
    works = parts.select(work.alias("id"), F.concat(F.lit("https://source/"), "p_brand").alias("source_url"))
    expected = parts.groupBy(F.concat(F.lit("https://source/"), "p_brand").alias("source_url")).agg(F.min("p_name").alias("name"))
    return images.matched_images(parts.select("id", work.alias("work_id")), works, hashed(parts, F.col("id"), F.col("p_name")), local, hashed(expected, F.col("source_url"), F.col("name")))


@query(f"WITH {_IMAGES} SELECT * FROM m")
def image_matches(spark, d):
    """Whether each image is the same in the store, in the folder and at its source."""
    return _images(spark, d)


@query(f"WITH {_IMAGES} SELECT count(*) AS images, CAST(count(*) FILTER (storage_matches_local) AS BIGINT) AS storage_matches_local, CAST(count(*) FILTER (storage_matches_expected) AS BIGINT) AS storage_matches_expected, CAST(count(*) FILTER (local_matches_expected) AS BIGINT) AS local_matches_expected, CAST(0 AS BIGINT) AS storage_missing, CAST(count(*) FILTER (local_bytes IS NULL) AS BIGINT) AS local_missing, CAST(0 AS BIGINT) AS expected_missing FROM m")
def image_match_summary(spark, d):
    """How many images are the same in how many places."""
    return images.match_summary(_images(spark, d))
