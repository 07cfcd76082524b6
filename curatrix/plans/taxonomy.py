"""Registered queries over rule tables, evidence and paged sources, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatrix.operators import evidence, rule_tables
from curatrix.operators.select import numbered
from curatrix.plans.registry import registry
from curatrix.sources import paged
from curatrix.sources.files import delete_at_end, shared_folder, table

QUERIES, SQL, query = registry()

_PLAIN = r"lower(trim(regexp_replace(regexp_replace({}, '[“”‘’\"''`]', '', 'g'), '\s+', ' ', 'g')))"
_WORDS = "(SELECT w, min(item_id) AS item_id FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM benchmark) GROUP BY w)"


@query(
    f"""
    WITH r AS (SELECT row_number() OVER (ORDER BY length(w) DESC, w) AS rank, CASE item_id % 4 WHEN 0 THEN 'prefix' WHEN 1 THEN 'suffix' ELSE 'contains' END AS kind, w AS anchor, 'item ' || item_id AS route FROM {_WORDS}),
    d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS t FROM documents),
    m AS (SELECT doc_id, min(rank) AS rank FROM d JOIN r ON CASE kind WHEN 'prefix' THEN starts_with(t, anchor) WHEN 'suffix' THEN ends_with(t, anchor) ELSE contains(t, anchor) END GROUP BY 1)
    SELECT doc_id, m.rank, route, anchor AS target FROM d LEFT JOIN m USING (doc_id) LEFT JOIN r ON r.rank = m.rank
    """
)
def rule_routes(spark, d):
    """Whole documents routed by the first of all long words of the benchmark, longest first, that they have."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("anchor")).groupBy("anchor").agg(F.min("item_id").alias("item_id"))
    ranked = numbered(words.withColumn("short", -F.length("anchor")), "short", "anchor", start=1)
    kind = F.when(F.col("item_id") % 4 == 0, "prefix").when(F.col("item_id") % 4 == 1, "suffix").otherwise("contains")
    rules = ranked.select(F.col("number").alias("rank"), kind.alias("kind"), "anchor", F.concat(F.lit("item "), "item_id").alias("route"), F.col("anchor").alias("target"))
    return rule_tables.first_rules(table(spark, d, "documents").select("doc_id", "text"), "text", rules).drop("text")


@query(
    f"""
    WITH l AS (SELECT p_partkey AS item, unnest(list_concat(string_split(p_name, ' '), [upper(p_type), p_brand, p_type || ' ' || p_name])) AS label FROM part),
    r AS (
        SELECT rank() OVER (ORDER BY o, anchor) AS rank, * FROM (
            SELECT 1 AS o, 'equals' AS kind, lower(p_brand) AS anchor, 'maker' AS route, '' AS target FROM part GROUP BY p_brand
            UNION ALL SELECT 2, 'prefix', lower(p_type), 'current', 'kind-' || lower(p_type) FROM part GROUP BY p_type
            UNION ALL SELECT 3, 'suffix', lower(regexp_extract(p_name, '[a-z]+$')), 'concept', 'thing-' || lower(regexp_extract(p_name, '[a-z]+$')) FROM part WHERE p_size % 2 = 0 GROUP BY ALL)
    ),
    p AS (SELECT DISTINCT item, label, {_PLAIN.format("label")} AS t FROM l),
    m AS (SELECT label, t, min(rank) AS rank FROM (SELECT DISTINCT label, t FROM p) JOIN r ON CASE kind WHEN 'equals' THEN t = anchor WHEN 'prefix' THEN starts_with(t, anchor) ELSE ends_with(t, anchor) END GROUP BY ALL),
    q AS (SELECT p.*, coalesce(route, 'unclassified') AS route, coalesce(nullif(target, ''), p.t) AS key FROM p LEFT JOIN m USING (label) LEFT JOIN r ON r.rank = m.rank),
    n AS (SELECT route, key, label, count(*) AS n FROM q GROUP BY ALL)
    SELECT route, key, (SELECT arg_min(label, (-n, label)) FROM n WHERE n.route = q.route AND n.key = q.key) AS label, count(DISTINCT item)::BIGINT AS n_items, count(DISTINCT label)::BIGINT AS n_labels, array_to_string(list_slice(list_sort(list_distinct(list(item))), 1, 10), ' ') AS sample
    FROM q GROUP BY route, key
    """
)
def taxonomy_analysis(spark, d):
    """Labels of works routed by a table of rules that the catalogue's own makers, kinds and things give: support, spellings
    and samples."""
    parts = table(spark, d, "part")
    makers = parts.select(F.lit(1).alias("o"), F.lit("equals").alias("kind"), F.lower("p_brand").alias("anchor"), F.lit("maker").alias("route"), F.lit("").alias("target"))
    kinds = parts.select(F.lit(2).alias("o"), F.lit("prefix").alias("kind"), F.lower("p_type").alias("anchor"), F.lit("current").alias("route"), F.concat(F.lit("kind-"), F.lower("p_type")).alias("target"))
    thing = F.lower(F.regexp_extract("p_name", "[a-z]+$", 0))
    things = parts.where("p_size % 2 = 0").select(F.lit(3).alias("o"), F.lit("suffix").alias("kind"), thing.alias("anchor"), F.lit("concept").alias("route"), F.concat(F.lit("thing-"), thing).alias("target"))
    rules = numbered(makers.union(kinds).union(things).distinct(), "o", "anchor").withColumnRenamed("number", "rank").drop("o")
    labels = parts.select("p_partkey", F.explode(F.concat(F.split("p_name", " "), F.array(F.upper("p_type"), "p_brand", F.concat_ws(" ", "p_type", "p_name")))).alias("label"))
    return rule_tables.analysis(labels, "p_partkey", "label", rules).withColumn("sample", F.array_join("sample", " "))


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment, ((row_number() OVER (ORDER BY c_custkey) - 1) // 500)::INTEGER AS page FROM customer")
def paged_read(spark, d):
    """Customers laid out in pages of 500, read back in parallel by the paged source and cleared of repeats."""
    path = f"{shared_folder(spark)}/paged/{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    rows = numbered(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey").withColumn("page", F.floor(F.col("number") / 500)).drop("number")
    rows.repartition("page").sortWithinPartitions("page", "c_custkey").write.partitionBy("page").json(path)
    name = f"pages_{uuid.uuid4().hex}"
    place = path if "://" in path else f"file://{path}"
    spark.dataSource.register(paged.paged(name, paged.Folder(place), "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"))
    return paged.sound(spark.read.format(name).load(), "c_custkey").drop("place")


@query(
    """
    WITH e AS (SELECT 's' || s_suppkey AS id, s_name AS label, 1900 + s_suppkey % 60 AS b, CAST(NULL AS BIGINT) AS dd, ['n' || s_nationkey] AS places, ['s' || (s_suppkey * 7 % 100), 'x' || s_suppkey] AS peers FROM supplier
               UNION ALL SELECT 'n' || n_nationkey, n_name, NULL, NULL, ['r' || n_regionkey], [] FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL, NULL, [], [] FROM region),
    t AS (SELECT c_custkey, 's' || (c_custkey % 150) AS entity_id, 1900 + c_custkey % 60 AS birth_year FROM customer WHERE c_acctbal >= 0)
    SELECT c_custkey AS _id, entity_id, coalesce(e.label, '') AS label, birth_year = e.b AND e.b IS NOT NULL AS birth_matches, coalesce((SELECT f.label FROM e f WHERE f.id = e.places[1]), '') AS places,
           CASE WHEN e.id IS NULL THEN '' ELSE coalesce((SELECT f.label FROM e f WHERE f.id = e.peers[1]), '') || '|' END AS peers
    FROM t LEFT JOIN e ON e.id = entity_id
    """
)
def creator_evidence(spark, d):
    """Evidence for customers in good standing from a table of entities: places and peers by name, years compared."""
    none = F.array().cast("array<string>")
    year = (F.lit(1900) + F.col("s_suppkey") % 60).alias("birth_year")
    blank = F.lit(None).cast("long")
    of = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    suppliers = table(spark, d, "supplier").select(of("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"), year, blank.alias("death_year"), F.array(of("n", "s_nationkey")).alias("places"), F.array(F.concat(F.lit("s"), (F.col("s_suppkey") * 7 % 100).cast("string")), of("x", "s_suppkey")).alias("peers"))
    nations = table(spark, d, "nation").select(of("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"), blank.alias("birth_year"), blank.alias("death_year"), F.array(of("r", "n_regionkey")).alias("places"), none.alias("peers"))
    regions = table(spark, d, "region").select(of("r", "r_regionkey").alias("id"), F.col("r_name").alias("label"), blank.alias("birth_year"), blank.alias("death_year"), none.alias("places"), none.alias("peers"))
    customers = table(spark, d, "customer")
    targets = customers.select(F.col("c_custkey").alias("_id"), F.concat(F.lit("s"), (F.col("c_custkey") % 150).cast("string")).alias("entity_id"), (F.lit(1900) + F.col("c_custkey") % 60).alias("birth_year"), blank.alias("death_year"))
    found = evidence.evidence(targets, customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("_id")), suppliers.unionByName(nations).unionByName(regions), ["places", "peers"])
    return found.select("_id", "entity_id", "label", "birth_matches", F.array_join("places", "|").alias("places"), F.array_join("peers", "|").alias("peers"))


@query(
    """
    WITH RECURSIVE e AS (SELECT 'p' || p_partkey AS id, ['p' || (p_partkey * 3), 'p' || (p_partkey + p_size)] AS refs FROM part),
    x(id, level) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_type = 'PROMO' AND p_size > 45 UNION SELECT r, level + 1 FROM (SELECT unnest(refs) AS r, level FROM x JOIN e USING (id) WHERE level < 3))
    SELECT id, min(level) AS level, id IN (SELECT id FROM e) AS found FROM x GROUP BY id
    """
)
def reference_levels(spark, d):
    """Works within three references of the large promotional ones, each at its first level."""
    parts = table(spark, d, "part")
    of = lambda c: F.concat(F.lit("p"), c.cast("string"))
    works = parts.select(of(F.col("p_partkey")).alias("key"), F.array(of(F.col("p_partkey") * 3), of(F.col("p_partkey") + F.col("p_size"))).alias("refs"))
    start = parts.where("p_type = 'PROMO' AND p_size > 45").select(of(F.col("p_partkey")).alias("id"))
    return evidence.expanded(start, works, "key", ["refs"], 3)
