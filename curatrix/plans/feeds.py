"""Queries that fill a reader's pages: searches over a corpus, channels and their sections, personal counts, renumbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.catalogue import SEARCH_ALIASES, SEARCH_FIELDS
from curatrix.operators import diff, matching, retrieval, rollup, select
from curatrix.plans.registry import registry
from curatrix.plans.serving import _SCORE
from curatrix.sources.files import table

QUERIES, SQL, query = registry()


def _score(text: str, queries: list[str]) -> str:
    plain = f"regexp_replace(lower({text}), '[ _,.:/()-]', '', 'g')"
    return "greatest(" + ", ".join(_SCORE.format(t=plain, f=text, q=q, p=q.replace(" ", "")) for q in queries) + ")"


_LEONARDO = ["leonardo", "列奥纳多·达·芬奇", "列奥纳多", "达·芬奇", "达芬奇", "leonardo da vinci", "da vinci"]


@query(
    f"""
    WITH w AS (SELECT p_partkey, p_name || CASE WHEN p_size > 45 THEN ' Leonardo' ELSE '' END AS title, CASE WHEN p_size % 7 = 0 THEN 'L. Da Vinci' ELSE p_brand END AS artist, p_type || CASE WHEN p_size = 3 THEN ' davinci' ELSE '' END AS tags FROM part),
    s AS (SELECT p_partkey, round(180 * {_score('title', _LEONARDO)} + 110 * {_score('artist', _LEONARDO)} + 55 * {_score('tags', _LEONARDO)}, 4)::DOUBLE AS score FROM w)
    SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25 OFFSET 5
    """
)
def search_works(spark, d):
    """The second page of a search over the catalogue's weighted fields, with the aliases of a name."""
    works = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") > 45, " Leonardo").otherwise("")).alias("title_cn"), F.when(F.col("p_size") % 7 == 0, "L. Da Vinci").otherwise(F.col("p_brand")).alias("artist"), F.array(F.col("p_type"), F.when(F.col("p_size") == 3, "davinci")).alias("tags"))
    corpus = retrieval.search_corpus(works, "p_partkey", SEARCH_FIELDS)
    return retrieval.searched(corpus, "p_partkey", "Leonardo", SEARCH_ALIASES, SEARCH_FIELDS, skip=5, size=25)


@query(
    """
    WITH i AS (SELECT DISTINCT p_brand, l_orderkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey), per AS (SELECT p_brand, l_suppkey, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT p_brand, count(DISTINCT l_orderkey) AS items FROM i GROUP BY 1),
    s AS (SELECT p_brand, any_value(items) AS items, count(*) AS creators, round(max(n) / any_value(items), 4)::DOUBLE AS share FROM per JOIN t USING (p_brand) GROUP BY 1)
    SELECT p_brand, round(log2(items + 1) * CASE WHEN share >= 0.7 THEN 0.8 ELSE greatest(0.4, 1 - 0.5 * share) END, 4)::DOUBLE AS priority, items >= 8 AND (share >= 0.7 OR (creators >= 3 AND share <= 0.65)) AS eligible FROM s WHERE items >= 8 AND p_brand <> 'Brand#12' ORDER BY priority DESC, p_brand LIMIT 10
    """
)
def listed_channels(spark, d):
    """Published channels by priority; a channel whose subject isn't published is held back."""
    links = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    policy = rollup.channel_policy(rollup.channel_stats(links, "p_brand", "l_orderkey", "l_suppkey")).withColumn("priority", F.round("priority", 4))
    created = rollup.created_channels(policy, F.col("p_brand") != "Brand#12")
    return rollup.listed_channels(created, "p_brand", 10).select("p_brand", "priority", "eligible")


@query("SELECT user_id, CAST(count(DISTINCT CASE WHEN event_type = 'click' THEN floor(value) END) AS BIGINT) AS favorites, CAST(count(DISTINCT CASE WHEN event_type = 'view' THEN floor(value) END) AS BIGINT) AS history, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS views FROM events GROUP BY user_id")
def library_stats(spark, d):
    """How much each user's library holds."""
    return rollup.library_stats(table(spark, d, "events"), "user_id", "event_type", F.floor("value"), "click", "view")


@query("WITH f AS (SELECT min(p_partkey) AS p_partkey, p_name || '|' || p_brand AS key FROM part WHERE p_brand <> 'Brand#11' GROUP BY 2) SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) + 6526 - 1 AS BIGINT) AS number FROM f")
def deduped_renumbered(spark, d):
    """Works without duplicates and without those already there, numbered densely from a start."""
    key = F.concat_ws("|", "p_name", "p_brand")
    parts = table(spark, d, "part").select("p_partkey", key.alias("key"))
    known = table(spark, d, "part").where("p_brand = 'Brand#11'").select(key.alias("key"))
    return select.numbered(diff.dedupe_first(parts, "key", "p_partkey", known), "p_partkey", start=6526).select("p_partkey", "number")


@query(
    """
    WITH u AS (SELECT user_id, least(count(*) FILTER (event_type = 'view'), 20) AS current FROM events GROUP BY 1), n AS (SELECT count(*) AS active, count(*) FILTER (current >= 20) AS unlocked FROM u)
    SELECT user_id, current, CAST(20 AS BIGINT) AS target, current >= 20 AS unlocked, round(100.0 * current / 20, 2)::DOUBLE AS percent, printf('%.2f%%', unlocked * 100.0 / active) AS unlock_rate FROM u, n
    """
)
def achievement_items(spark, d):
    """An achievement as each user sees it: progress to its target, and how many have it."""
    views = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"))
    return rollup.achievement_items(views, "user_id", F.col("views"), 20)


@query(
    """
    WITH c AS (SELECT v.channel, v.place, p_partkey, row_number() OVER (PARTITION BY v.channel ORDER BY p_retailprice, p_partkey) AS rn FROM (VALUES ('reds', 1, 'red'), ('blues', 2, 'blue'), ('promos', 3, 'PROMO')) v(channel, place, value) JOIN part ON list_contains(list_append(string_split(p_name, ' '), p_type), v.value))
    SELECT channel, p_partkey FROM c WHERE rn <= 6
    """
)
def channel_sections(spark, d):
    """The first works of each of a page's channels."""
    channels = spark.createDataFrame([("reds", "red"), ("blues", "blue"), ("promos", "PROMO")], "channel string, value string")
    tags = F.concat(F.split("p_name", " "), F.array("p_type"))
    return rollup.channel_sections(channels, "channel", "value", table(spark, d, "part"), "p_partkey", tags, 6, "p_retailprice")


@query(
    """
    SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT doc_id) AS repeated, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS undecided, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS selected, CAST(count(*) FILTER (quality = 0 OR toxic = 1) AS BIGINT) AS rejected, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS missing FROM labels
    """
)
def review_audit(spark, d):
    """A review's outcome: decided, repeated, and not yet reviewed at all."""
    good, bad = (F.col("quality") == 1) & (F.col("toxic") == 0), (F.col("quality") == 0) | (F.col("toxic") == 1)
    return rollup.review_audit(table(spark, d, "labels"), "doc_id", bad, good, F.col("quality").isNull(), table(spark, d, "documents"))


@query(
    """
    WITH RECURSIVE s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier),
    c AS (SELECT turn, s_suppkey, p_partkey, p_brand, p_name, max(l_extendedprice) AS score FROM lineitem JOIN s ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    t AS (
        SELECT 0::BIGINT AS turn, NULL::BIGINT AS s_suppkey, NULL::BIGINT AS p_partkey, []::BIGINT[] AS items, []::VARCHAR[] AS brands, []::VARCHAR[] AS names
        UNION ALL
        SELECT turn, b.s, b.i, CASE WHEN b.i IS NULL THEN items ELSE list_append(items, b.i) END, CASE WHEN b.i IS NULL THEN brands ELSE list_append(brands, b.b) END, CASE WHEN b.i IS NULL THEN names ELSE list_append(names, b.n) END
        FROM (
            SELECT t.turn + 1 AS turn, items, brands, names, arg_min({'s': c.s_suppkey, 'i': c.p_partkey, 'b': p_brand, 'n': p_name}, (-score, c.p_partkey)) AS b
            FROM t LEFT JOIN c ON c.turn = t.turn + 1 AND NOT list_contains(items, c.p_partkey) AND len(list_filter(brands, lambda x: x = p_brand)) < 6 AND len(list_filter(names, lambda x: x = p_name)) < 4
            WHERE t.turn < (SELECT max(turn) FROM s) GROUP BY t.turn, items, brands, names
        )
    )
    SELECT s_suppkey, p_partkey FROM t WHERE p_partkey IS NOT NULL
    """
)
def best_unused(spark, d):
    """Each supplier in turn, richest first, takes its dearest unused part, at most 6 of a brand and 4 of a name over all."""
    turns = select.numbered(table(spark, d, "supplier").select("s_suppkey", (-F.col("s_acctbal")).alias("poor")), "poor", "s_suppkey").select("s_suppkey", F.col("number").alias("turn"))
    offers = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("score"))
    rows = offers.join(turns, "s_suppkey").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_name"), "p_partkey").withColumn("worse", -F.col("score"))
    found, _ = matching.taken_in_turn(rows, "turn", ["worse", "p_partkey"], {"item": (["p_partkey"], 1), "brand": (["p_brand"], 6), "name": (["p_name"], 4)})
    return found.select("s_suppkey", "p_partkey")
