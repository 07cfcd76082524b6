"""Queries that govern the catalogue: resolving names, roll-ups, channels, deduplication, differences, release checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import diff, resolve, retrieval, rollup, select
from curatrix.plans.registry import registry
from curatrix.plans.serving import part_tags
from curatrix.sources import files
from curatrix.sources.files import table

QUERIES, SQL, query = registry()


#: A small vocabulary: term, aliases.
VOCABULARY = [("hue-red", "red"), ("hue-blue", "blue"), ("form-ring", "ring"), ("form-round", "ring"), ("form-gear", "gear"), ("form-plate", "plate"), ("age-old", "old"), ("age-cold", "cold"), ("age-old", "old plate")]
_VOCAB_SQL = "(VALUES " + ", ".join(f"('{t}', '{a}')" for t, a in VOCABULARY) + ") AS v(id, alias)"


def vocabulary(spark):
    rows = {}
    for term, alias in VOCABULARY:
        rows.setdefault(term, []).append(alias)
    return resolve.alias_index(spark.createDataFrame(list(rows.items()), "id string, aliases array<string>"), "id", F.col("aliases"))


@query(
    f"""
    WITH v AS (SELECT alias, list_sort(list(DISTINCT id)) AS ids FROM {_VOCAB_SQL} GROUP BY alias),
    l AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part)
    SELECT p_partkey, label, CASE WHEN label IN ('small', 'large') THEN 'noise' WHEN ids IS NULL THEN 'unmatched' WHEN len(ids) = 1 THEN 'unique' ELSE 'ambiguous' END AS route,
           CASE WHEN label NOT IN ('small', 'large') AND len(ids) = 1 THEN ids[1] END AS term_id
    FROM l LEFT JOIN v ON alias = label
    """
)
def alias_route(spark, d):
    """Labels routed by the vocabulary: noise, unique, ambiguous, unmatched."""
    labels = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("label"))
    return resolve.routed(labels, "label", vocabulary(spark), noise=["small", "large"]).select("p_partkey", "label", "route", "term_id")


@query(
    f"""
    WITH l AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS label FROM part), v AS (SELECT alias, count(DISTINCT id) AS k FROM {_VOCAB_SQL} GROUP BY alias)
    SELECT label, CASE WHEN k IS NULL THEN 'unmatched' ELSE 'ambiguous' END AS reason, count(*) AS n FROM l LEFT JOIN v ON alias = label WHERE k IS NULL OR k > 1 GROUP BY ALL
    """
)
def review_queue(spark, d):
    """Labels left for review, by text and reason."""
    labels = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("label"))
    routed = resolve.routed(labels, "label", vocabulary(spark)).where(F.col("route").isin("unmatched", "ambiguous"))
    return routed.groupBy("label", F.col("route").alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""
    SELECT p_partkey, min(id) AS id FROM part JOIN {_VOCAB_SQL} ON contains(lower(p_name), alias) GROUP BY p_partkey HAVING count(DISTINCT id) = 1
    """
)
def unique_containment(spark, d):
    """Works whose name contains aliases of one single term."""
    return resolve.uniquely_contained(table(spark, d, "part"), "p_partkey", "p_name", vocabulary(spark))


@query(
    """
    WITH i AS (SELECT alias, min(id) AS id FROM (SELECT p_partkey AS id, unnest(list_concat(string_split(p_name, ' '), CASE WHEN p_size % 5 = 0 THEN [p_name] ELSE [] END)) AS alias FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) WHERE length(alias) >= 3 GROUP BY alias),
    t AS (SELECT p_partkey, lower(p_name) AS part FROM part),
    m AS (SELECT part, alias, id, CASE WHEN alias = part THEN 0 ELSE 1 END AS step FROM (SELECT DISTINCT part FROM t) JOIN i ON contains(part, alias) OR contains(alias, part)),
    b AS (SELECT part, id, step FROM m QUALIFY row_number() OVER (PARTITION BY part ORDER BY step, length(alias) DESC, alias) = 1)
    SELECT p_partkey, id, CASE WHEN step = 0 THEN 'exact' ELSE 'contained' END AS found_by FROM t JOIN b USING (part)
    """
)
def found_creators(spark, d):
    """Creators found by free text: names of works against the names, whole and by word, of three makers' works."""
    parts = table(spark, d, "part")
    some = parts.where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    aliases = some.select("p_partkey", F.explode(F.concat(F.split("p_name", " "), F.when(F.col("p_size") % 5 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")))).alias("alias"))
    index = aliases.where("length(alias) >= 3").groupBy("alias").agg(F.array(F.min("p_partkey")).alias("ids"))
    return resolve.found_creator(parts, "p_partkey", "p_name", index)


@query(
    f"""
    WITH v AS (SELECT alias, min(id) AS id FROM {_VOCAB_SQL} GROUP BY alias)
    SELECT p_partkey, alias, id FROM part JOIN v ON contains(lower(p_name), alias) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, alias) = 1
    """
)
def longest_alias(spark, d):
    """The longest alias that a name contains."""
    return resolve.longest_contained(table(spark, d, "part"), "p_partkey", "p_name", vocabulary(spark))


@query(
    f"""
    WITH v AS (SELECT alias, min(id) AS id FROM {_VOCAB_SQL} GROUP BY alias),
    j AS (SELECT p_partkey, a.id AS whole, b.id AS first, CASE WHEN p_type = 'PROMO' THEN 'type-promo' END AS by_type FROM part LEFT JOIN v a ON a.alias = p_name LEFT JOIN v b ON b.alias = split_part(p_name, ' ', 1))
    SELECT p_partkey, coalesce(whole, first, by_type) AS resolved, CASE WHEN whole IS NOT NULL THEN 'name' WHEN first IS NOT NULL THEN 'first word' WHEN by_type IS NOT NULL THEN 'type' ELSE 'unresolved' END AS match_source FROM j
    """
)
def cascade_resolve(spark, d):
    """Resolution in steps, the first that matches names the source."""
    index = vocabulary(spark).select("alias", F.element_at("ids", 1).alias("id"))
    whole, first = (index.select(F.col("alias").alias(a), F.col("id").alias(i)) for a, i in (("a1", "whole"), ("a2", "first")))
    parts = table(spark, d, "part")
    joined = parts.join(whole, F.col("a1") == F.col("p_name"), "left").join(first, F.col("a2") == F.substring_index("p_name", " ", 1), "left").withColumn("by_type", F.when(F.col("p_type") == "PROMO", "type-promo"))
    return resolve.cascade(joined, [("name", "whole"), ("first word", "first"), ("type", "by_type")]).select("p_partkey", "resolved", "match_source")


@query(
    """
    WITH b AS (SELECT l_orderkey, l_suppkey, min(CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END) AS p FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, arg_min(l_suppkey, (p, l_suppkey)) AS primary_id, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY p, l_suppkey) AS ids FROM b GROUP BY l_orderkey
    """
)
def role_priority_primary(spark, d):
    """Linked creators of each work by role priority, and its primary one."""
    out = resolve.links_by_role(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag", ["N", "A", "R"])
    return out.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(
    """
    WITH l AS (SELECT l_suppkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_suppkey)
    SELECT s_suppkey, coalesce(parts, '') AS parts FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey
    """
)
def derived_records(spark, d):
    """Records with their links collected, those without too."""
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    out = resolve.with_collected(table(spark, d, "supplier"), "s_suppkey", links, "l_partkey", "l_partkey", "parts")
    return out.select("s_suppkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


_STATS = """
    items AS (SELECT DISTINCT p_brand, l_orderkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey),
    per AS (SELECT p_brand, l_suppkey, count(DISTINCT l_orderkey) AS n FROM items GROUP BY ALL),
    stats AS (SELECT p_brand, (SELECT count(DISTINCT l_orderkey) FROM items i WHERE i.p_brand = per.p_brand) AS item_count, count(*) AS creator_count, arg_min(l_suppkey, (-n, l_suppkey)) AS top_creator, max(n) AS top_count FROM per GROUP BY p_brand)
"""


def _brand_stats(spark, d):
    links = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rollup.channel_stats(links, "p_brand", "l_orderkey", "l_suppkey")


@query(f"WITH {_STATS} SELECT p_brand, item_count, creator_count, top_creator, top_count, round(top_count / item_count, 4)::DOUBLE AS top_share FROM stats")
def channel_stats(spark, d):
    """Channels: items, creators, the top creator and its share."""
    return _brand_stats(spark, d)


@query(
    f"""
    WITH {_STATS}, s AS (SELECT *, round(top_count / item_count, 4)::DOUBLE AS share FROM stats),
    m AS (SELECT *, CASE WHEN p_brand = 'Brand#11' THEN 7 WHEN share >= 0.7 THEN top_creator END AS scope FROM s), p AS (SELECT *, item_count >= 8 AS capacity_ready, scope IS NOT NULL OR (creator_count >= 3 AND share <= 0.65) AS diversity_ready FROM m)
    SELECT p_brand, CASE WHEN scope IS NULL THEN 'cross_artist' ELSE 'artist_focus' END AS mode, scope, capacity_ready, diversity_ready, capacity_ready AND diversity_ready AS eligible, CASE WHEN capacity_ready THEN 'published' ELSE 'long_tail' END AS status,
           round(log2(item_count + 1) * CASE WHEN scope IS NOT NULL THEN 0.8 ELSE greatest(0.4, 1 - 0.5 * share) END, 4)::DOUBLE AS priority FROM p
    """
)
def channel_policy(spark, d):
    """What a channel's numbers allow, and its priority; one brand is about a creator by decree."""
    forced = F.when(F.col("p_brand") == "Brand#11", 7)
    return rollup.channel_policy(_brand_stats(spark, d), forced).select("p_brand", "mode", "scope", "capacity_ready", "diversity_ready", "eligible", "status", F.round("priority", 4).alias("priority"))


@query(
    """
    WITH g AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM g),
    r AS (SELECT *, CAST(n >= 2 OR n / total >= 0.1 AS INTEGER) AS ok FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ok DESC, n DESC, p_brand) AS rn FROM r)
    SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY rn) AS ids FROM k WHERE (ok = 1 AND rn <= 5) OR rn = 1 GROUP BY l_suppkey
    """
)
def representative_ids(spark, d):
    """What a creator's works stand for: frequent enough terms, else the one most frequent."""
    links = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    counts = links.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    totals = counts.groupBy("l_suppkey").agg(F.sum("n").alias("total"))
    out = rollup.representative_ids(counts.join(totals, "l_suppkey"), "l_suppkey", "p_brand", "n", "total")
    return out.withColumn("ids", F.array_join("ids", ","))


@query(
    """
    WITH b AS (SELECT CAST(floor(p_partkey % 997 / 25) AS BIGINT) AS bin FROM part)
    SELECT r.bin, count(b.bin) AS n FROM (SELECT unnest(range(40)) AS bin) r LEFT JOIN b USING (bin) GROUP BY r.bin
    """
)
def bucket_histogram(spark, d):
    """A histogram that keeps its empty bins."""
    return rollup.histogram(table(spark, d, "part"), F.col("p_partkey") % 997, 25, 40)


@query("SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def count_by_value(spark, d):
    """Group counts, missing values as unknown."""
    return rollup.count_by(table(spark, d, "documents"), "lang")


@query(
    """
    WITH a AS (SELECT o_custkey, count(*) AS actual FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), s AS (SELECT c_custkey, CAST(c_custkey % 7 AS BIGINT) AS stored FROM customer)
    SELECT c_custkey, stored, coalesce(actual, 0) AS actual FROM s LEFT JOIN a ON o_custkey = c_custkey WHERE stored IS DISTINCT FROM coalesce(actual, 0)
    """
)
def count_drift(spark, d):
    """Stored counts that differ from recomputed ones."""
    actual = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    stored = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 7).cast("bigint").alias("stored_count"))
    return rollup.count_drift(stored, "c_custkey", "stored_count", actual)


@query(
    """
    WITH r AS (SELECT DISTINCT substr(p_name, 1, 3) AS key, p_name AS label, p_partkey AS item FROM part), s AS (SELECT key, label, count(*) AS k FROM r GROUP BY ALL)
    SELECT key, (SELECT count(DISTINCT item) FROM r WHERE r.key = s.key) AS n, arg_min(label, (-k, label)) AS label, string_agg(label, ',' ORDER BY label) AS aliases,
           (SELECT string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) FROM (SELECT DISTINCT item FROM r WHERE r.key = s.key ORDER BY item LIMIT 10)) AS sample
    FROM s GROUP BY key
    """
)
def vocabulary_candidates(spark, d):
    """Candidate terms: groups of spellings with counts and sample items."""
    out = rollup.candidates(table(spark, d, "part"), F.substring("p_name", 1, 3), "p_name", "p_partkey")
    return out.select("key", "n", "label", F.array_join("aliases", ",").alias("aliases"), F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


@query(
    """
    WITH k AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) AS key FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) AS key FROM benchmark)
    SELECT min(doc_id) AS doc_id, md5(key) AS key FROM k WHERE key <> '' AND key NOT IN (SELECT key FROM b) GROUP BY key
    """
)
def dedupe_first(spark, d):
    """Of documents with the same normalised text the first, known texts left out."""
    key = lambda c: F.md5(F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " ")))
    docs = table(spark, d, "documents").where(F.trim(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")) != "").select("doc_id", key("text").alias("key"))
    return diff.dedupe_first(docs, "key", "doc_id", table(spark, d, "benchmark").select(key("text").alias("key")))


@query("SELECT s_name, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) + 999 AS BIGINT) AS number FROM supplier")
def dense_numbers(spark, d):
    """Dense renumbering from 1000 in an order, without one task that sees all rows."""
    return select.numbered(table(spark, d, "supplier"), "s_acctbal", "s_suppkey", start=1000).select("s_name", "number")


@query(
    """
    WITH i AS (SELECT DISTINCT l_partkey AS id FROM lineitem), g AS (SELECT id, id - row_number() OVER (ORDER BY id) AS run FROM i)
    SELECT min(id) AS first, max(id) AS last, count(*) AS size FROM g GROUP BY run
    """
)
def islands(spark, d):
    """Ranges of consecutive keys."""
    return select.islands(table(spark, d, "lineitem"), "l_partkey")


_STATES = """
    cur AS (SELECT p_partkey AS k, CASE WHEN p_size > 30 THEN 'x' ELSE p_type END AS v FROM part UNION ALL SELECT -s_suppkey, s_name FROM supplier),
    prev AS (SELECT p_partkey AS k, CASE WHEN p_size > 40 THEN 'x' ELSE p_type END AS v FROM part UNION ALL SELECT 1000000000 + c_custkey, c_mktsegment FROM customer),
    target AS (SELECT p_partkey AS k, CASE WHEN p_retailprice > 1500 THEN 'y' ELSE p_type END AS v FROM part UNION ALL SELECT 1000000000 + c_custkey, c_mktsegment FROM customer UNION ALL SELECT 2000000000 + o_orderkey, o_orderstatus FROM orders)
"""


def _states(spark, d):
    """Three states of a record table, each of whole tables: works in all of them, with values that change by size and price;
    creators only now, customers before and wanted, orders only wanted."""

    def works(changed, mark: str):
        return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(changed, mark).otherwise(F.col("p_type")).alias("v"))

    def others(name: str, key, value: str):
        return table(spark, d, name).select(key.alias("k"), F.col(value).alias("v"))

    customers = others("customer", F.lit(1_000_000_000) + F.col("c_custkey"), "c_mktsegment")
    current = works(F.col("p_size") > 30, "x").unionByName(others("supplier", -F.col("s_suppkey"), "s_name"))
    wanted = works(F.col("p_retailprice") > 1500, "y").unionByName(customers).unionByName(others("orders", F.lit(2_000_000_000) + F.col("o_orderkey"), "o_orderstatus"))
    return current, works(F.col("p_size") > 40, "x").unionByName(customers), wanted


@query(
    f"""
    WITH {_STATES}
    SELECT coalesce(cur.k, prev.k, target.k) AS k, CASE WHEN cur.v IS NOT DISTINCT FROM target.v THEN 'applied' WHEN cur.v IS NOT DISTINCT FROM prev.v THEN 'pending' ELSE 'mismatch' END AS state
    FROM cur FULL JOIN prev ON cur.k = prev.k FULL JOIN target ON target.k = coalesce(cur.k, prev.k)
    """
)
def preflight_state(spark, d):
    """Rows against the state before and the state wanted."""
    current, previous, target = _states(spark, d)
    return diff.preflight(current, previous, target, "k")


@query(
    f"""
    WITH {_STATES}
    SELECT k, 'unexpected' AS problem FROM cur WHERE k NOT IN (SELECT k FROM prev) AND k NOT IN (SELECT k FROM target)
    UNION ALL SELECT k, 'missing' FROM prev WHERE k IN (SELECT k FROM target) AND k NOT IN (SELECT k FROM cur)
    """
)
def transition(spark, d):
    """Ids that a transition can't explain."""
    return diff.transition(*_states(spark, d), "k")


@query(f"WITH {_STATES} SELECT k, v, 'added' AS change FROM (SELECT * FROM target EXCEPT SELECT * FROM cur) UNION ALL SELECT k, v, 'removed' FROM (SELECT * FROM cur EXCEPT SELECT * FROM target)")
def reconcile(spark, d):
    """Links added and removed."""
    current, _, target = _states(spark, d)
    return diff.reconciled(current, target, ["k", "v"])


@query(f"WITH {_STATES} SELECT cur.k, 'v' AS changed FROM cur JOIN target ON cur.k = target.k WHERE cur.v IS DISTINCT FROM target.v")
def changed_fields(spark, d):
    """Rows of both states with the fields that differ."""
    current, _, target = _states(spark, d)
    return diff.changed_rows(current, target, "k").withColumn("changed", F.array_join("changed", ","))


@query(f"WITH {_STATES} SELECT k, v FROM cur WHERE k NOT IN (SELECT k FROM target) UNION ALL SELECT k, v FROM target")
def keyed_upsert(spark, d):
    """Current rows with the target's put in place or added."""
    current, _, target = _states(spark, d)
    return files.upserted(current, target, ["k"])


@query(f"WITH {_STATES} SELECT k, v FROM cur UNION ALL SELECT k, v FROM target WHERE k NOT IN (SELECT k FROM cur)")
def insert_if_absent(spark, d):
    """Current rows and those of new keys."""
    current, _, target = _states(spark, d)
    return files.inserted_if_absent(current, target, ["k"])


@query(f"WITH {_STATES} SELECT k, coalesce(target.v, cur.v) AS v FROM cur FULL JOIN target USING (k)")
def merged_rows(spark, d):
    """Right-biased merge of two states."""
    current, _, target = _states(spark, d)
    return files.merged(current, target, ["k"])


@query(f"WITH {_STATES} SELECT k, v FROM cur WHERE k NOT IN (SELECT k FROM target)")
def stale_rows(spark, d):
    """Rows to prune: not in the target."""
    current, _, target = _states(spark, d)
    return files.without(current, target, ["k"])


@query(
    """
    WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS segment, c_nationkey, c_name FROM customer),
    u AS (SELECT 1 AS part, c_nationkey AS key, segment, c_name FROM r WHERE segment IS NOT NULL UNION ALL SELECT 2, c_nationkey, 'late', c_name FROM r)
    SELECT key, arg_min(c_name, (part, segment, c_name)) AS c_name, arg_min(segment, (part, segment, c_name)) AS segment FROM u GROUP BY key
    """
)
def union_first_wins(spark, d):
    """Pages put together, of each key that of the earliest."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.when(F.col("c_acctbal") > 3000, F.col("c_mktsegment")).alias("segment"), "c_name")
    return diff.union_first_wins("key", rows.where("segment IS NOT NULL"), rows.withColumn("segment", F.lit("late")))


@query(
    """
    WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN value END AS a, CASE WHEN event_type = 'click' THEN value END AS b FROM events)
    SELECT user_id, arg_max(a, CASE WHEN a IS NOT NULL THEN event_id END) AS a, arg_max(b, CASE WHEN b IS NOT NULL THEN event_id END) AS b FROM p GROUP BY user_id
    """
)
def patch_fold(spark, d):
    """Patches in order folded to one row per key."""
    events = table(spark, d, "events")
    patches = events.select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("a"), F.when(F.col("event_type") == "click", F.col("value")).alias("b"))
    return diff.folded_patches(patches, "user_id", "event_id")


@query(
    """
    SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size >= 10 THEN 'small' END, CASE WHEN NOT p_retailprice < 1500 THEN 'dear' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END) AS reasons,
           round(0.45 * CAST(p_size >= 10 AS INTEGER) + 0.15 * CAST(p_retailprice < 1500 AS INTEGER) + 0.4 * CAST(p_type <> 'PROMO' AS INTEGER), 4)::DOUBLE AS score
    FROM part
    """
)
def reasons_array(spark, d):
    """Why a work is not eligible, and its quality score."""
    rules = {"small": F.col("p_size") >= 10, "dear": F.col("p_retailprice") < 1500, "promo": F.col("p_type") != "PROMO"}
    weights = {"small": 0.45, "dear": 0.15, "promo": 0.4}
    score = F.round(sum((F.lit(w) * rules[r].cast("int") for r, w in weights.items()), F.lit(0.0)), 4)
    return table(spark, d, "part").select("p_partkey", F.array_join(diff.failed_reasons(rules), ",").alias("reasons"), score.alias("score"))


@query(
    """
    SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT o_totalprice > 20000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_orderpriority LIKE '_-%' THEN 'priority' END]) AS rule FROM orders) WHERE rule IS NOT NULL
    """
)
def quality_errors(spark, d):
    """One row per violated rule."""
    rules = {"price": F.col("o_totalprice") > 20000, "status": F.col("o_orderstatus").isin("F", "O"), "priority": F.col("o_orderpriority").like("_-%")}
    return diff.violations(table(spark, d, "orders"), "o_orderkey", rules)


@query(
    """
    SELECT CAST(l_partkey AS BIGINT) AS key, 'part' AS parent, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49) GROUP BY l_partkey
    UNION ALL SELECT l_suppkey, 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 500) GROUP BY l_suppkey
    """
)
def orphan_audit(spark, d):
    """Links whose target isn't published."""
    lines = table(spark, d, "lineitem")
    parts = diff.orphans(lines, "l_partkey", table(spark, d, "part").where("p_size < 49"), "p_partkey").withColumn("parent", F.lit("part"))
    creators = diff.orphans(lines, "l_suppkey", table(spark, d, "supplier").where("s_acctbal > 500"), "s_suppkey").withColumn("parent", F.lit("supplier"))
    return parts.unionByName(creators).select("key", "parent", "n")


@query(
    """
    SELECT count(*) AS documents, count(l.doc_id) AS labelled, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS good, round(count(l.doc_id) / count(*), 4)::DOUBLE AS coverage
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    """
)
def coverage_audit(spark, d):
    """Coverage of documents by labels."""
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumnRenamed("doc_id", "labelled_id"), F.col("doc_id") == F.col("labelled_id"), "left")
    return joined.agg(F.count("*").alias("documents"), F.count("labelled_id").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.count("labelled_id") / F.count("*"), 4).alias("coverage"))


@query("SELECT lower(p_name) AS alias, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def alias_conflicts(spark, d):
    """Aliases that more than one record claims."""
    return diff.conflicting_aliases(table(spark, d, "part"), "p_brand", F.col("p_name"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, d):
    """Keys seen more than once."""
    return files.repeated_keys(table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), "id")


@query(
    """
    WITH a AS (SELECT count(*)::DOUBLE AS orders, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS published FROM orders WHERE year(o_orderdate) < 1998), b AS (SELECT count(*)::DOUBLE AS orders, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS published FROM orders)
    SELECT 'orders' AS metric, a.orders AS before, b.orders AS after, b.orders - a.orders AS delta FROM a, b UNION ALL SELECT 'published', a.published, b.published, b.published - a.published FROM a, b
    """
)
def audit_deltas(spark, d):
    """Two reports compared metric by metric."""
    orders = table(spark, d, "orders")
    report = lambda df: df.agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("published"))
    return diff.metric_deltas(report(orders.where(F.year("o_orderdate") < 1998)), report(orders))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{T.RESTRICTED}') THEN 'blocked' WHEN regexp_matches(lower(text), '{T.FREE}') THEN 'open' ELSE 'unknown' END AS licence FROM documents")
def licence_status(spark, d):
    """Licence assessment of whole texts."""
    return table(spark, d, "documents").select("doc_id", T.licence_status("text").alias("licence"))


@query(
    """
    SELECT p_partkey, regexp_extract(t, '\\(([0-9]{4})\\)', 1)::INTEGER AS year, 'period-' || (regexp_extract(t, '\\(([0-9]{4})\\)', 1)::INTEGER // 10 * 10) || 's' AS decade
    FROM (SELECT p_partkey, p_name || ' (' || CAST(1200 + p_partkey % 800 AS VARCHAR) || ')' AS t FROM part)
    """
)
def title_years(spark, d):
    """Years and decades out of titles."""
    titled = table(spark, d, "part").withColumn("t", F.concat("p_name", F.lit(" ("), (1200 + F.col("p_partkey") % 800).cast("string"), F.lit(")")))
    return titled.select("p_partkey", T.title_and_year("t")[1].alias("year"), T.earliest_decade("t").alias("decade"))


@query(
    """
    WITH s AS (SELECT part, type, n FROM (SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1), (VALUES ('p')) v(part))
    SELECT type AS value, n, CAST(row_number() OVER (ORDER BY n DESC, type) AS INTEGER) AS place FROM s
    """
)
def ranked_counts(spark, d):
    """Values by count, ties by name, numbered over all tasks."""
    counts = rollup.count_by(table(spark, d, "part"), "p_type").withColumn("less", -F.col("n"))
    return select.numbered(counts, "less", "value", start=1).select("value", "n", F.col("number").cast("int").alias("place"))


@query("SELECT p_partkey, CAST(list_contains(string_split(p_name, ' '), 'old') AS INTEGER) AS old, CAST(len(list_filter(list_append(string_split(p_name, ' '), p_type), lambda t: t IN ('red', 'blue', 'ECONOMY'))) AS INTEGER) AS hits FROM part")
def tag_hits(spark, d):
    """How many of a list of tags each work has."""
    wanted = F.array(*[F.lit(t) for t in ("red", "blue", "ECONOMY")])
    return part_tags(spark, d).select("p_partkey", retrieval.has_all("tags", ["old"]).cast("int").alias("old"), F.size(F.filter("tags", lambda t: F.array_contains(wanted, t))).alias("hits"))
