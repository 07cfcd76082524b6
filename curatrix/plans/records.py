"""Queries that clean records and rank candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import rules as R
from curatrix.functions import text as T
from curatrix.operators import ranking, resolve
from curatrix.plans.registry import registry
from curatrix.plans.serving import part_tags
from curatrix.sources.files import table

QUERIES, SQL, query = registry()


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, p_brand AS creator, array_to_string(list_append(string_split(p_name, ' '), p_type), ',') AS tags FROM part")
def canonical_records(spark, d):
    """Records in canonical form: fallbacks for id, title and creator, tags from several fields."""
    raw = table(spark, d, "part").select(F.lit("").alias("_id"), F.col("p_partkey").cast("string").alias("source_id"), F.concat(F.lit(" "), "p_name").alias("title_cn"), F.lit(None).cast("string").alias("artist"), F.col("p_brand").alias("raw_artist"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("tags_text"), F.concat("p_type", F.lit(";;")).alias("more_tags"))
    return raw.select(*R.artwork(["_id", "source_id"], ["title_cn"], ["artist", "raw_artist"], ["tags_text", "more_tags"])).withColumn("tags", F.array_join("tags", ","))


@query(
    """
    SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(old|cold)') THEN 'age' WHEN regexp_matches(p_name, '(red|blue)') THEN 'hue' WHEN regexp_matches(p_name, '(small|large)') THEN 'size' ELSE 'other' END AS kind,
           CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'low' WHEN 'SMALL' THEN 'mid' ELSE 'none' END AS class
    FROM part
    """
)
def ordered_rules(spark, d):
    """Labels by ordered rules, and by a fixed map."""
    rules = [("old|cold", "age"), ("red|blue", "hue"), ("small|large", "size")]
    return table(spark, d, "part").select("p_partkey", R.first_rule("p_name", rules, "other").alias("kind"), R.looked_up("p_type", {"ECONOMY": "low", "PROMO": "low", "SMALL": "mid"}, "none").alias("class"))


@query(
    """
    WITH t AS (SELECT p_partkey, 1200 + p_partkey % 800 AS y, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size > 25 THEN 'c. ' || y || '-' || (y + 3) ELSE CAST(y AS VARCHAR) END AS years, (y // 10 * 10) || 's' AS decade, CAST(y AS INTEGER) AS born, CAST(y + 30 AS INTEGER) AS died
    FROM t
    """
)
def year_texts(spark, d):
    """Year texts, decades and lifespans, a death year of two digits completed."""
    t = table(spark, d, "part").withColumn("y", 1200 + F.col("p_partkey") % 800)
    text = F.when(F.col("p_size") > 25, F.concat(F.lit("ca. "), F.col("y").cast("string"), F.lit(" – "), (F.col("y") + 3).cast("string"))).otherwise(F.concat(F.col("y").cast("string"), F.lit("")))
    life = F.concat(F.lit("Name ("), F.col("y").cast("string"), F.lit("-"), F.substring((F.col("y") + 30).cast("string"), 3, 2), F.lit(")"))
    t = t.withColumn("text", text).withColumn("life", life)
    born, died = R.lifespan("life")
    return t.select("p_partkey", R.year_text("text").alias("years"), R.decade_labels("text").alias("decade"), born.alias("born"), died.alias("died"))


@query("SELECT p_partkey, p_size > 40 AS is_file, round(p_size / (p_size % 7 + 1), 6)::DOUBLE AS ratio, CASE WHEN p_type = 'PROMO' THEN 'format' WHEN p_size * 20 < 600 THEN 'small' ELSE 'ok' END AS verdict FROM part")
def media_checks(spark, d):
    """Formats, sizes and ratios of image fields."""
    t = table(spark, d, "part").withColumn("medium", F.when(F.col("p_size") > 40, "JPEG image").otherwise("oil")).withColumn("dims", F.concat_ws(" x ", F.col("p_size").cast("string"), (F.col("p_size") % 7 + 1).cast("string")))
    verdict = R.image_verdict(F.col("p_size") * 20, F.lit(5000), F.when(F.col("p_type") == "PROMO", "image/bmp").otherwise("image/png"))
    return t.select("p_partkey", R.is_file_format("medium").alias("is_file"), F.round(R.ratio("dims"), 6).alias("ratio"), verdict.alias("verdict"))


@query(
    """
    WITH t AS (SELECT p_partkey, list_distinct(list_append(string_split(p_name, ' '), p_type)) AS tags, string_split(p_name, ' ') AS w, p_type FROM part)
    SELECT p_partkey, CAST(least(len(tags), 6) + greatest(4 - len(tags), 0) AS INTEGER) AS n, list_contains(tags, 'red') AS red FROM t
    """
)
def padded_tags(spark, d):
    """Tag lists filled up to four."""
    padded = part_tags(spark, d).withColumn("padded", R.padded_tags("tags", ["filler a", "filler b", "filler c", "filler d"]))
    return padded.select("p_partkey", F.size("padded").alias("n"), F.array_contains("padded", "red").alias("red"))


@query(
    """
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, CASE WHEN length(t) > 399 THEN rtrim(substr(t, 1, 399)) ELSE t END AS c FROM t)
    SELECT doc_id, CASE WHEN regexp_matches(c, '[.!?]$') OR c = '' THEN c ELSE c || '.' END AS description FROM c
    """
)
def clipped_descriptions(spark, d):
    """Descriptions cut to length with a closing mark; the feature is the cut."""
    return table(spark, d, "documents").select("doc_id", R.clipped("text").alias("description"))


@query(
    """
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'idiot')) AS f0, len(list_filter(w, lambda x: x = 'from')) AS f1 FROM w),
    t AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM c)
    SELECT doc_id, round(2.0 * ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 6)::DOUBLE AS score
    FROM c, t WHERE f0 > 0 OR f1 > 0
    """
)
def relevance(spark, d):
    """BM25 of a query over whole documents, with a boost."""
    return ranking.bm25(table(spark, d, "documents"), "doc_id", "text", ["idiot", "from"], {"idiot": 2.0})


@query("SELECT p_partkey, CAST(100 * (CAST(p_name LIKE '%red%' AS INTEGER) + CAST(p_name LIKE '%gear%' AS INTEGER)) + p_size - CASE WHEN p_type = 'PROMO' THEN 250 ELSE 0 END AS INTEGER) AS score FROM part")
def listing_scores(spark, d):
    """Listings scored against a query."""
    return table(spark, d, "part").select("p_partkey", ranking.listing_score(F.col("p_name"), "red gear", F.col("p_size"), F.col("p_type") == "PROMO").alias("score"))


def _short(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("score"), F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_suppkey", "l_extendedprice").alias("tie"), (F.col("l_returnflag") == "R").alias("is_external"))
    once = ranking.short_lists(rows, "l_suppkey", "l_partkey", "score", "tie", F.col("is_external"))
    return once.select("l_suppkey", "l_partkey", "rank")


_SHORT = """
    r AS (SELECT l_suppkey, l_partkey, CAST(l_quantity AS BIGINT) AS score, l_orderkey * 8 + l_linenumber AS id, l_extendedprice AS price, l_returnflag = 'R' AS ext FROM lineitem),
    once AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, id, l_suppkey, price) = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, id, l_suppkey, price) AS place FROM once),
    w AS (SELECT *, max(CAST(place <= 3 AND ext AS INTEGER)) OVER (PARTITION BY l_suppkey) AS has, min(CASE WHEN ext THEN place END) OVER (PARTITION BY l_suppkey) AS nxt FROM k),
    short AS (SELECT l_suppkey, l_partkey, CAST(least(place, 3) AS INTEGER) AS rank FROM w WHERE CASE WHEN has = 0 AND nxt IS NOT NULL THEN place < 3 OR place = nxt ELSE place <= 3 END)
"""


@query(f"WITH {_SHORT} SELECT l_suppkey, l_partkey, rank FROM short")
def short_lists(spark, d):
    """Per owner the best three candidates, each file used once, with one external if there is any."""
    return _short(spark, d)


@query(
    f"""
    WITH {_SHORT}, o AS (SELECT l_suppkey, l_partkey AS override FROM short WHERE rank = 2 AND l_suppkey % 2 = 0),
    p AS (SELECT short.l_suppkey, l_partkey, row_number() OVER (PARTITION BY short.l_suppkey ORDER BY CASE WHEN l_partkey = override THEN 0 ELSE 1 END, rank) AS rn FROM short LEFT JOIN o ON o.l_suppkey = short.l_suppkey)
    SELECT l_suppkey, max(CASE WHEN rn = 1 THEN l_partkey END) AS selected, max(CASE WHEN rn = 2 THEN l_partkey END) AS alternate FROM p WHERE rn <= 2 GROUP BY l_suppkey
    """
)
def final_decisions(spark, d):
    """Per owner the chosen candidate and the alternate, overrides first."""
    short = _short(spark, d)
    overrides = short.where("rank = 2 AND l_suppkey % 2 = 0").select("l_suppkey", F.col("l_partkey").alias("override"))
    return ranking.decisions(short, "l_suppkey", "l_partkey", "rank", overrides)


@query(
    """
    WITH q AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label, p_size FROM part)
    SELECT p_partkey, label, CASE WHEN label = 'red' AND p_size > 25 THEN 'creator' WHEN label = 'hot' THEN 'ignored' WHEN label IN ('red', 'blue', 'bolt') THEN 'linked' ELSE 'unresolved' END AS outcome,
           CASE WHEN label = 'red' AND p_size > 25 THEN NULL WHEN label IN ('red', 'blue') THEN 'warm' WHEN label = 'bolt' THEN 'metal' END AS signal_id
    FROM q
    """
)
def signal_assignments(spark, d):
    """Labels routed to signals; those that name a creator, or are ignored, set aside."""
    parts = table(spark, d, "part")
    queue = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("label"))
    index = resolve.alias_index(spark.createDataFrame([("warm", ["red", "blue", "gear"]), ("metal", ["bolt", "gear"])], "id string, a array<string>"), "id", F.col("a"))
    creators = parts.where("p_size > 25").select("p_partkey", F.lit("Red").alias("creator_label"))
    return ranking.signal_assignments(queue, "label", "p_partkey", index, ["hot"], creators)


@query(
    """
    SELECT c.channel, coalesce(n, 0) AS n FROM (VALUES ('reds', 'tags', 'red'), ('promos', 'kinds', 'PROMO'), ('none', 'tags', 'PROMO-X')) c(channel, field, value)
    LEFT JOIN (SELECT 'tags' AS field, t AS value, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY t UNION ALL SELECT 'kinds', p_type, count(*) FROM part GROUP BY p_type) USING (field, value)
    """
)
def recounted_channels(spark, d):
    """Channels' sizes counted anew."""
    channels = spark.createDataFrame([("reds", "tags", "red"), ("promos", "kinds", "PROMO"), ("none", "tags", "PROMO-X")], "channel string, field string, value string")
    items = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"), F.array("p_type").alias("kinds"))
    return ranking.recounted_channels(channels, "channel", "field", "value", items, "p_partkey", ["tags", "kinds"])


@query("SELECT s_suppkey, (row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) // 12 AS batch, (row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) % 12 AS place FROM supplier")
def rollout_batches(spark, d):
    """A rollout in batches of twelve."""
    return ranking.batches(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", size=12).select("s_suppkey", "batch", "place")


@query("SELECT c_custkey, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN 'near' ELSE coalesce(lower(r_name), 'other') END AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def region_cascade(spark, d):
    """Regions by alias, else by country, else other; the dimensions are small tables."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region").where("r_name <> 'ASIA'")
    joined = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select("c_custkey", R.looked_up("n_name", {"NATION_1": "near", "NATION_2": "near"}, F.coalesce(F.lower("r_name"), F.lit("other"))).alias("region"))


@query("SELECT doc_id, regexp_replace(text, '(?i)\\b(token|secret|password|api_?key|authorization)(\\s*[:=]\\s*)(\"[^\"]*\"|[^\\s&,;\"]+)', '\\1\\2[redacted]', 'g') AS text FROM documents")
def redacted_texts(spark, d):
    """Values behind secret-looking keys masked."""
    return table(spark, d, "documents").select("doc_id", T.redacted("text").alias("text"))


@query("SELECT l_orderkey, string_agg(f, ',' ORDER BY p, f) AS flags FROM (SELECT DISTINCT l_orderkey, l_returnflag AS f, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS p FROM lineitem) GROUP BY l_orderkey")
def priority_lists(spark, d):
    """Values each once, those of a list first."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return rows.select("l_orderkey", F.array_join(R.priority_sorted("flags", ["R", "A"], 5), ",").alias("flags"))
