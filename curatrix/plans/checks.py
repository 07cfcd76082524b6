"""Queries that hold records against their kinds' rules, audit creators, and prepare releases and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.catalogue import ACHIEVEMENTS, PREFIXES
from curatrix.operators import checks, release
from curatrix.plans.registry import registry
from curatrix.sources.files import table

QUERIES, SQL, query = registry()


def _artists(spark, d):
    """Suppliers as creators' records with gaps of all kinds."""
    n, b = F.col("s_suppkey"), F.col("s_acctbal")
    sources = F.when(b > 2000, F.array(F.struct(F.lit("").alias("title"), F.when(b > 7000, "https://w.x/y").otherwise(" ").alias("url"))))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("s"), n.cast("string")).alias("_id"),
        F.when(b > 0, F.col("s_name")).otherwise(" ").alias("name_zh"),
        F.when(b > 1000, F.when(b > 9000, F.concat(F.lit("Studio of "), "s_name")).otherwise(F.col("s_name"))).alias("name_en"),
        F.when(b > 1500, F.array(F.col("s_name"), F.when(b > 8000, F.concat(F.upper("s_name"), F.lit(" "))).when(b > 7500, "").otherwise("x"))).alias("aliases"),
        F.when(b > 6000, "reviewed").when(b > 500, "candidate").otherwise("new").alias("review_status"),
        sources.alias("sources"),
        F.when(b > 8500, F.create_map(F.lit("wikidata"), F.lit("Q1"))).alias("authority_ids"),
        F.when(b > 4000, "person").otherwise("robot").alias("entity_type"),
        F.when(b > 5000, "verified").otherwise("unresolved").alias("identity_status"),
        F.lit(None).cast("string").alias("unresolved_reason"),
        F.concat(F.repeat(F.lit("ab "), F.floor(b / 40).cast("int")), F.when(b > 4500, "1850")).alias("bio_zh"),
        F.when(b > 3000, F.struct(F.lit("x").alias("lifespan"), F.lit("").alias("title"), F.lit("y").alias("career"), F.lit("z").alias("standing"))).alias("bio_facts"),
        F.lit(1850).alias("birth_year"),
        F.when(b > 5500, 1900).alias("death_year"),
        F.when(b > 3500, F.array(F.lit("painter"))).alias("occupations_zh"),
        F.when(b > 2500, "fr").alias("country_code"),
        F.when(b > 3000, F.array(F.lit("w1"))).alias("representative_artwork_ids"),
        F.when(b > 6500, "France").otherwise("未知").alias("country"),
        F.lit("Europe").alias("region"),
        F.lit("1850-1900").alias("lifespan_text"),
        F.when(b > 9500, "hidden").alias("public_visibility"),
        F.floor(b / 200).cast("long").alias("artwork_count"),
    )


_A = """a AS (SELECT 's' || s_suppkey AS _id, s_acctbal AS b, repeat('ab ', CAST(floor(s_acctbal / 40) AS INTEGER)) || CASE WHEN s_acctbal > 4500 THEN '1850' END AS bio FROM supplier),
    l AS (SELECT *, length(replace(coalesce(bio, ''), ' ', '')) AS n FROM a)"""


@query(
    f"""
    WITH {_A}
    SELECT _id, field, rule FROM (SELECT _id, unnest([
        CASE WHEN NOT b > 0 THEN ('name_zh', 'name_zh') END, CASE WHEN NOT b > 1000 THEN ('name_en', 'name_en') END, CASE WHEN NOT b > 500 THEN ('review_status', 'status') END,
        CASE WHEN NOT b > 1500 THEN ('aliases', 'aliases') END, CASE WHEN b > 7500 AND b <= 8000 THEN ('aliases', 'empty alias') END, CASE WHEN b > 8000 THEN ('aliases', 'duplicate alias') END,
        CASE WHEN b > 6000 AND b <= 7000 THEN ('sources', 'evidence') END]) AS e, e[1] AS field, e[2] AS rule FROM l) WHERE e IS NOT NULL
    """
)
def artist_errors(spark, d):
    """What reviewed creators' records break."""
    return checks.broken(_artists(spark, d), "_id", checks.artist_rules())


@query(
    f"""
    WITH {_A}
    SELECT _id, rule FROM (SELECT _id, unnest([
        CASE WHEN NOT b > 4000 THEN 'entity' END, CASE WHEN NOT b > 0 THEN 'name_zh' END, CASE WHEN NOT b > 1000 THEN 'name_en' END, CASE WHEN NOT b > 1500 THEN 'aliases' END, CASE WHEN NOT b > 2000 THEN 'sources' END,
        CASE WHEN b > 5000 AND b <= 7000 THEN 'authority' END, CASE WHEN b <= 5000 THEN 'reason' END, CASE WHEN n NOT BETWEEN 200 AND 300 THEN 'length' END,
        CASE WHEN b <= 3000 THEN 'fact lifespan' END, 'fact title', CASE WHEN b <= 3000 THEN 'fact career' END, CASE WHEN b <= 3000 THEN 'fact standing' END,
        CASE WHEN b > 4000 AND NOT b > 4500 THEN 'birth year' END, CASE WHEN b > 5500 THEN 'death year' END]) AS rule FROM l) WHERE rule IS NOT NULL
    """
)
def enrichment_errors(spark, d):
    """What finished creators' records break, their biographies included."""
    return checks.broken(_artists(spark, d), "_id", checks.enrichment_rules()).select("_id", "rule")


@query(
    f"""
    WITH {_A}, k AS (SELECT *, CASE WHEN b > 9000 THEN 'workshop' WHEN b > 500 AND b <= 6000 THEN 'unresolved' ELSE 'person' END AS kind FROM l),
    g AS (SELECT *, list_filter([CASE WHEN b <= 2500 THEN 'country_code' END, CASE WHEN b <= 3500 THEN 'occupations_zh' END, CASE WHEN b <= 3000 THEN 'bio_facts' END, CASE WHEN b <= 3000 THEN 'representative_artwork_ids' END,
        CASE WHEN n NOT BETWEEN 200 AND 300 THEN 'bio_length' END, CASE WHEN kind = 'person' AND b <= 8500 THEN 'authority_ids' END, CASE WHEN b <= 6500 THEN 'country_placeholder' END, CASE WHEN kind = 'person' AND b <= 5500 THEN 'death_year' END], lambda x: x IS NOT NULL) AS gaps FROM k)
    SELECT _id, kind AS inferred_entity_type, CASE WHEN kind = 'unresolved' THEN 'unresolved' WHEN b > 6000 AND b > 8500 THEN 'verified' ELSE 'provisional' END AS proposed_identity_status, n AS bio_char_count, array_to_string(gaps, ',') AS gaps,
           CASE WHEN (b > 500 AND b <= 6000) OR kind <> 'person' THEN 'P0' WHEN list_contains(gaps, 'bio_length') OR list_contains(gaps, 'country_placeholder') THEN 'P1' ELSE 'P2' END AS research_priority FROM g
    """
)
def artist_audit(spark, d):
    """Kind, identity, gaps and priority of creators' records."""
    return checks.artist_audit(_artists(spark, d)).withColumn("bio_char_count", F.col("bio_char_count").cast("bigint")).withColumn("gaps", F.array_join("gaps", ","))


@query(
    """
    SELECT id, rule FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, unnest([CASE WHEN l_suppkey <= 3 THEN 'creator' END, CASE WHEN l_returnflag = 'N' THEN 'role' END, CASE WHEN l_linestatus = 'O' THEN 'status' END]) AS rule FROM lineitem) WHERE rule IS NOT NULL
    """
)
def link_errors(spark, d):
    """What links of works and creators break."""
    links = table(spark, d, "lineitem").select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("id"), F.lit("x").alias("_id"), F.col("l_orderkey").cast("string").alias("artwork_id"), F.when(F.col("l_suppkey") > 3, "a").otherwise(" ").alias("artist_id"), F.when(F.col("l_linestatus") == "O", "odd").otherwise("candidate").alias("review_status"), F.when(F.col("l_returnflag") != "N", "creator").otherwise("friend").alias("role"))
    return checks.broken(links, "id", checks.link_rules()).select("id", "rule")


def _terms(spark, d):
    """Parts as vocabulary terms, with ids, kinds and labels that break rules."""
    return table(spark, d, "part").select(
        F.when(F.col("p_size") == 7, "style-7").otherwise(F.concat(F.when(F.col("p_size") > 40, "period-").otherwise("style-"), F.when(F.col("p_size") > 45, "18").otherwise(""), F.col("p_partkey").cast("string"), F.lit("s"))).alias("_id"),
        F.when(F.col("p_size") > 40, "period").when(F.col("p_size") > 38, "mood").when(F.col("p_size") > 35, "subject").otherwise("style").alias("type"),
        F.lit(" ").alias("period_kind"),
        F.when(F.col("p_size") > 2, F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("label_zh"),
        F.lit("").alias("label_en"),
        F.when(F.col("p_size") > 48, F.array(F.lit(" Shared "), F.lit(""))).alias("aliases"),
        F.when(F.col("p_size") == 11, "style-none").alias("parent_id"),
        F.col("p_size"),
        F.col("p_partkey"),
    )


@query(
    """
    WITH t AS (SELECT CASE WHEN p_size = 7 THEN 'style-7' WHEN p_size > 45 THEN 'period-18' || p_partkey || 's' ELSE NULL END AS i, p_partkey, p_size FROM part),
    k AS (SELECT coalesce(i, CASE WHEN p_size > 40 THEN 'period-' ELSE 'style-' END || p_partkey || 's') AS _id, p_partkey, p_size, CASE WHEN p_size > 40 THEN 'period' WHEN p_size > 38 THEN 'mood' WHEN p_size > 35 THEN 'subject' ELSE 'style' END AS type FROM t),
    e AS (SELECT *, type = 'period' AND regexp_full_match(_id, 'period-[0-9]{4}s') AS decade, p_partkey <= 100 AS existing FROM k)
    SELECT p_partkey, _id, CASE WHEN decade THEN 'decade' ELSE '' END AS period_kind, CASE WHEN existing THEN 'published' ELSE 'draft' END AS publish_status, 'reviewed' AS review_status, CASE WHEN p_size > 20 THEN 'Brand ' || p_size ELSE '' END AS artist_id, CAST(1000 + 10 * p_size AS BIGINT) AS sort_order, 'controlled-vocabulary-v2' AS taxonomy_version, existing AND (type IN ('style', 'subject') OR decade) AS display_enabled,
           CASE WHEN type = 'mood' THEN 'search,metadata' WHEN type IN ('style', 'subject') OR decade THEN 'search,metadata,recommendation,classification_filter' ELSE 'search,metadata,recommendation' END AS usage_scopes FROM e
    """
)
def enriched_terms(spark, d):
    """Vocabulary terms in full."""
    rows = _terms(spark, d)
    keyed = rows.withColumn("label_en", F.col("p_partkey").cast("string")).withColumn("artist_id", F.when(F.col("p_size") > 20, F.concat(F.lit(" Brand "), "p_size"))).withColumn("sort_order", 1000 + 10 * F.col("p_size"))
    out = checks.enriched_terms(keyed, F.col("p_partkey") <= 100)
    return out.select(F.col("label_en").cast("bigint").alias("p_partkey"), "_id", "period_kind", "publish_status", "review_status", "artist_id", "sort_order", "taxonomy_version", "display_enabled", F.array_join("usage_scopes", ",").alias("usage_scopes"))


@query(
    """
    WITH t AS (SELECT p_partkey, p_size, p_name, CASE WHEN p_size = 7 THEN 'style-7' WHEN p_size > 45 THEN 'period-18' || p_partkey || 's' WHEN p_size > 40 THEN 'period-' || p_partkey || 's' ELSE 'style-' || p_partkey || 's' END AS _id FROM part)
    SELECT 'unknown_type' AS code, _id AS term FROM t WHERE p_size IN (39, 40) UNION ALL SELECT 'invalid_id_prefix', _id FROM t WHERE p_size IN (36, 37, 38) UNION ALL SELECT 'missing_label_zh', _id FROM t WHERE p_size <= 2
    UNION ALL SELECT 'duplicate_term_id', _id FROM t GROUP BY _id HAVING count(*) > 1 UNION ALL SELECT 'missing_parent', _id FROM t WHERE p_size = 11 UNION ALL SELECT 'alias_conflict', 'shared' FROM t WHERE p_size > 48 HAVING count(*) > 1
    """
)
def vocabulary_errors(spark, d):
    """What a vocabulary breaks, its aliases and parents included."""
    terms = checks.enriched_terms(_terms(spark, d), F.lit(True))
    return checks.vocabulary_errors(terms, PREFIXES)


@query(
    """
    SELECT count(*) AS total, count(*) FILTER (text IS NULL OR text = '') AS missing_images, count(*) FILTER (lang = 'en') AS missing_tags, (SELECT count(*) FROM (SELECT source FROM documents GROUP BY source HAVING count(*) > 1)) AS duplicate_ids FROM documents
    """
)
def document_summary(spark, d):
    """Documents without images or tags, and repeated keys."""
    docs = table(spark, d, "documents").withColumn("tags", F.when(F.col("lang") != "en", F.array("lang")))
    return checks.document_summary(docs, "source", ["text"], "tags")


@query(
    f"""
    WITH {_A}, k AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1), q AS (SELECT a._id, b, coalesce(n, 0) AS linked FROM a LEFT JOIN k ON 's' || l_suppkey = _id WHERE b > 6000 AND b <= 9500)
    SELECT _id, 'person' AS entity_type, CASE WHEN b > 7000 THEN 'conflicted' ELSE 'verified' END AS identity_status, CAST(floor(b / 200) AS BIGINT) AS artwork_count, linked AS linked_artwork_count, b <= 7000 AS search_eligible, CASE WHEN b > 7000 THEN 'identity_unresolved' ELSE 'pending' END AS final_status,
           CASE WHEN b > 9000 THEN 'P1' WHEN floor(b / 200) >= 50 THEN 'P0' WHEN floor(b / 200) >= 10 THEN 'P1' ELSE 'P2' END AS target_priority FROM q
    """
)
def portrait_queue(spark, d):
    """Visible creators for whom a portrait may be searched, with their works counted."""
    artists = _artists(spark, d)
    governance = table(spark, d, "supplier").where("s_acctbal > 7000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("_id"), F.lit(" ").alias("entity_type"), F.lit("conflicted").alias("identity_status"), F.when(F.col("s_acctbal") > 9000, "P1").otherwise("?").alias("research_priority"))
    links = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("artist_id"), F.col("l_orderkey").alias("artwork_id"))
    return release.portrait_queue(artists, governance, links)


@query(
    """
    WITH t AS (SELECT p_partkey, p_size > 25 AND p_type <> 'PROMO' AS released, p_type FROM part)
    SELECT p_partkey AS query_value, CASE WHEN released THEN CASE WHEN p_size > 30 THEN 'published' ELSE 'long_tail' END ELSE 'candidate' END AS channel_status, released AND p_size > 30 AND p_size < 40 AS auto_feature_eligible FROM t JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)
    """
)
def release_channels(spark, d):
    """Channels of the terms that a release promotes."""
    parts = table(spark, d, "part")
    terms = release.promoted_terms(parts.select(F.col("p_partkey").alias("_id"), F.when(F.col("p_type") == "PROMO", "candidate").otherwise("reviewed").alias("review_status"), F.when(F.col("p_size") > 25, "draft").otherwise("published").alias("publish_status")))
    channels = parts.select(F.col("p_partkey").alias("query_value"), F.lit("controlled_term").alias("kind"), (F.col("p_size") > 30).alias("capacity_ready"), (F.col("p_size") < 40).alias("diversity_ready"), F.lit("candidate").alias("channel_status"), F.lit(False).alias("auto_feature_eligible"))
    return release.promoted_channels(channels, terms).select("query_value", "channel_status", "auto_feature_eligible")


@query("SELECT p_partkey, p_type, p_size, p_brand, 'v2' AS release_version FROM part")
def release_works(spark, d):
    """Works with their patches and the release's version."""
    parts = table(spark, d, "part")
    works = parts.select("p_partkey", "p_type", F.lit("old").alias("p_brand"), F.lit(1).alias("previous"), F.lit(True).alias("changed"))
    return release.released_works(works, parts.select("p_partkey", "p_size", "p_brand", F.lit(0).alias("previous")), "p_partkey", "v2")


def _accounts(spark, d):
    events = table(spark, d, "events")
    metrics = events.groupBy("user_id").agg(F.count_distinct(F.when(F.col("event_type") == "click", F.floor("value"))).alias("favorite_unique_count"), F.count_distinct(F.when(F.col("event_type") == "signup", F.floor("value"))).alias("followed_artist_unique_count"), F.count_distinct(F.when(F.col("event_type") == "view", "event_id")).alias("history_unique_count"))
    owned = events.where("event_type = 'purchase'").select("user_id", F.when(F.col("value") > 100, "learned_all_ages").when(F.col("value") > 50, "first_masterpiece").otherwise("gone").alias("achievement_id"))
    return metrics, owned


_ACCOUNTS = f"""
    m AS (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'click' THEN floor(value) END) AS favorite_unique_count, count(DISTINCT CASE WHEN event_type = 'signup' THEN floor(value) END) AS followed_artist_unique_count, count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) AS history_unique_count FROM events GROUP BY 1),
    o AS (SELECT DISTINCT user_id, CASE WHEN value > 100 THEN 'learned_all_ages' ELSE 'first_masterpiece' END AS achievement_id FROM events WHERE event_type = 'purchase' AND value > 50),
    e AS ({' UNION ALL '.join(f"SELECT user_id, '{name}' AS achievement_id FROM m" + (f" WHERE {metric} >= {least}" if metric else "") for name, (_, grant, metric, least, _) in ACHIEVEMENTS.items() if grant != 'manual')}),
    w AS (SELECT user_id, achievement_id, false AS is_new FROM o UNION ALL SELECT user_id, achievement_id, true FROM e WHERE (user_id, achievement_id) NOT IN (SELECT (user_id, achievement_id) FROM o))
"""


@query(f"WITH {_ACCOUNTS} SELECT user_id, achievement_id, is_new, 'ach_' || substr(sha256(user_id || chr(0) || achievement_id), 1, 48) AS document_id FROM w")
def owned_achievements(spark, d):
    """What users own and newly earn."""
    return release.owned_achievements(*_accounts(spark, d)).withColumn("document_id", release.achievement_document("user_id", "achievement_id"))


@query(f"WITH {_ACCOUNTS}, u AS (SELECT DISTINCT user_id, CASE WHEN user_id <= 40 THEN 'ordinary_user' ELSE 'learned_all_ages' END AS title FROM events) SELECT user_id, CASE WHEN (user_id, title) IN (SELECT (user_id, achievement_id) FROM w) THEN title ELSE 'ordinary_user' END AS equipped_title_id FROM u WHERE user_id > 90 OR NOT (user_id, title) IN (SELECT (user_id, achievement_id) FROM w)")
def account_updates(spark, d):
    """Accounts to bring up to the schema."""
    owned = release.owned_achievements(*_accounts(spark, d))
    users = table(spark, d, "events").select("user_id").distinct().select("user_id", (F.col("user_id") <= 90).alias("registered"), F.when(F.col("user_id") <= 40, "ordinary_user").otherwise("learned_all_ages").alias("equipped_title_id"), F.lit(1).alias("schema_version"))
    return release.account_updates(users, owned, 1)
