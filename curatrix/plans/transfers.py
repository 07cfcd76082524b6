"""Queries that read and write records, fetch single ones, and clean their fields one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curatrix.functions import rules as R
from curatrix.functions import text as T
from curatrix.functions import unicode as U
from curatrix.operators import retrieval, select
from curatrix.plans.registry import registry
from curatrix.sources import files
from curatrix.sources.files import table
from curatrix.streaming import library

QUERIES, SQL, query = registry()

#: The most lines that a task sorts, on average.
LINES = 1_000_000


def _place(spark) -> str:
    path = f"{files.shared_folder(spark)}/transfers/{uuid.uuid4().hex}"
    files.delete_at_end(spark, path)
    return path


@query("SELECT p_partkey, p_name, array_to_string(string_split(p_name, ' '), '|') AS words, p_retailprice FROM part")
def json_round_trip(spark, d):
    """Records written as JSON Lines and read again with their schema."""
    path = _place(spark)
    files.write_json_lines(table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"), "p_retailprice"), path)
    back = files.json_records(spark, path, "p_partkey LONG, p_name STRING, words ARRAY<STRING>, p_retailprice DOUBLE")
    return back.withColumn("words", F.array_join("words", "|"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, 'say \"' || text || '\", then' AS text, role || '|' || role AS tags FROM conversations")
def csv_round_trip(spark, d):
    """Texts with quotes, commas and line breaks, and lists, written as CSV and read again."""
    path = _place(spark)
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit('say "'), "text", F.lit('", then')).alias("text"), F.array("role", "role").alias("tags"))
    files.write_csv(rows, path)
    return files.csv_records(spark, path, "conv_id STRING, turn STRING, role STRING, text STRING, tags STRING")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text, 'a|' || source AS tags FROM documents WHERE text <> ''")
def spreadsheet_csv(spark, d):
    """Whole texts with line breaks written for spreadsheet programs and read again."""
    path = _place(spark)
    rows = table(spark, d, "documents").where("text <> ''").select("doc_id", "lang", "text", F.array(F.lit("a"), "source").alias("tags"))
    files.write_csv(rows, path, windows=True)
    return files.csv_records(spark, path, "doc_id STRING, lang STRING, text STRING, tags STRING")


@query("SELECT c_custkey, c_name FROM customer")
def published_table(spark, d):
    """A table put in place whole, twice; a table that isn't there has no rows."""
    path = _place(spark)
    files.published(table(spark, d, "customer").select("c_custkey", F.lit("old").alias("c_name")), path)
    files.published(table(spark, d, "customer").select("c_custkey", "c_name"), path)
    return files.optional_table(spark, path, "c_custkey LONG, c_name STRING").unionByName(files.optional_table(spark, f"{path}-none", "c_custkey LONG, c_name STRING"))


@query(
    """
    WITH w AS (SELECT 'w' || p_partkey AS id, CASE WHEN p_size > 3 THEN CAST(p_partkey * 2 AS VARCHAR) END AS second, p_name, p_size = 7 AS gone FROM part),
    a AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'w' || l_partkey * 2 ELSE 'artwork_' || l_partkey END AS asked FROM lineitem),
    f AS (SELECT asked, id, p_name, gone FROM a JOIN w ON id = asked),
    s AS (SELECT asked, min(id) AS id, arg_min(p_name, id) AS p_name, arg_min(gone, id) AS gone FROM a JOIN w ON second = regexp_replace(asked, '^artwork_', '') WHERE asked NOT IN (SELECT asked FROM f) GROUP BY asked)
    SELECT asked, CASE WHEN r.id IS NULL THEN 'absent' WHEN gone THEN 'hidden' ELSE 'found' END AS answer, CASE WHEN NOT gone THEN r.id END AS id, CASE WHEN NOT gone THEN r.p_name END AS p_name FROM a LEFT JOIN (SELECT * FROM f UNION ALL SELECT * FROM s) r USING (asked)
    """
)
def works_by_ids(spark, d):
    """Works by their own or a second id: found, hidden or absent."""
    works = table(spark, d, "part").select(F.concat(F.lit("w"), "p_partkey").alias("id"), F.when(F.col("p_size") > 3, (F.col("p_partkey") * 2).cast("string")).alias("second"), "p_name", (F.col("p_size") == 7).alias("gone"))
    asked = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("w"), (F.col("l_partkey") * 2).cast("string"))).otherwise(F.concat(F.lit("artwork_"), "l_partkey")).alias("asked"))
    return retrieval.pointed(asked, works, "id", "second", "artwork_", F.col("gone")).select("asked", "answer", "id", "p_name")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42")
def work_by_id(spark, d):
    """One work by its id."""
    return retrieval.by_key(table(spark, d, "part"), "p_partkey", 42).select("p_partkey", "p_name", "p_brand")


@query(
    """
    WITH cur AS (SELECT o_orderkey, 'primary' AS kind, 'old' AS url FROM orders WHERE o_orderstatus = 'F'), new AS (SELECT o_orderkey, CASE WHEN l_linenumber = 1 THEN 'primary' ELSE 'detail' END AS kind, min(c_name || '/' || l_partkey) AS url FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT * FROM new UNION ALL SELECT * FROM cur WHERE (o_orderkey, kind) NOT IN (SELECT (o_orderkey, kind) FROM new)
    """
)
def image_upsert(spark, d):
    """Images of works by their kind, put in place or added from a join of three tables."""
    orders, customer, lines = (table(spark, d, n) for n in ("orders", "customer", "lineitem"))
    current = orders.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("primary").alias("kind"), F.lit("old").alias("url"))
    # a kind's first line is found before names are put to it, by one sort of narrow rows that the join with the orders uses too;
    # such keys take very little room when moved, so tasks are made by rows and not by Spark from what it moves
    n, least = lines.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ["l_orderkey"] if n <= LINES else [max(least, -(-n // LINES)), "l_orderkey"]
    primary = F.coalesce(F.col("l_linenumber") == 1, F.lit(False)).alias("primary")
    first = lines.select("l_orderkey", primary, F.col("l_partkey").cast("string").alias("part")).repartition(*dealt).groupBy("l_orderkey", "primary").agg(F.min("part").alias("part"))
    owners = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("o_orderkey").agg(F.collect_set("c_name").alias("names"))
    url = F.array_min(F.transform("names", lambda name: F.concat(name, F.lit("/"), "part"))).alias("url")
    new = owners.join(first.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.when(F.col("primary"), "primary").otherwise("detail").alias("kind"), url)
    return files.upserted(current, new, ["o_orderkey", "kind"])


@query(
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'device' WHEN value > 150 THEN 'item' WHEN ts > TIMESTAMP '2024-01-21 00:00:00' THEN 'time' END AS problem, CASE WHEN event_type = 'view' THEN true ELSE false END AS deleted, CAST(least(greatest(floor(value) * 10000, 0), 1000000) AS BIGINT) AS device_count FROM events
    """
)
def checked_mutations(spark, d):
    """Mutations with what is wrong with them, and bounded counts."""
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "x").otherwise(" dev_abcdefgh1 ").alias("device_id"), F.when(F.col("value") > 150, " ").otherwise("item").alias("item_id"), F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "view", True).alias("deleted"), (F.floor("value") * 10000).alias("device_count"))
    return library.checked_mutations(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "problem", "deleted", "device_count")


@query(
    """
    SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_name END AS name, CASE WHEN p_size > 25 THEN 'unknown' ELSE p_type END AS place, p_size > 30 AS pixels, CASE WHEN p_size > 10 THEN 'style' ELSE 'unknown' END AS dimension, p_size % 2 = 0 AS same, 1800 + p_size AS first_year, array_to_string([1800 + p_size, 1999], ',') AS years, CAST(2 AS INTEGER) AS n_sentences FROM part
    """
)
def cleaned_fields(spark, d):
    """Fields of records one by one: missing words, places, sizes, dimensions, sets, years, sentences."""
    rows = table(spark, d, "part").withColumn("dated", F.concat(F.lit("in "), (1800 + F.col("p_size")).cast("string"), F.lit(" (or 1999). No 12345!")))
    return rows.select(
        "p_partkey",
        T.missing_as_null(F.when(F.col("p_size") > 40, " Undefined ").otherwise(F.concat(F.lit("　"), "p_name"))).alias("name"),
        R.known_place(F.when(F.col("p_size") > 25, ", Crawl.org").otherwise(F.col("p_type")), ["crawl.org"]).alias("place"),
        R.is_pixel_size(F.when(F.col("p_size") > 30, "100 × 200 px").otherwise("100 x 200 cm")).alias("pixels"),
        T.dimension(F.when(F.col("p_size") > 10, F.concat(F.lit("style-"), "p_name")).otherwise("none")).alias("dimension"),
        T.same_set(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))).alias("same"),
        T.first_year(F.lit("none"), "dated").alias("first_year"),
        F.array_join(F.transform(T.years("dated"), lambda y: y.cast("string")), ",").alias("years"),
        F.size(T.sentences("dated")).alias("n_sentences"),
    )


@query(
    """
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS link, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages)
    SELECT page_id, link, regexp_extract(url, '^[a-z]+://[^/?#]*') || link AS target, lang FROM l
    """
)
def absolute_links(spark, d):
    """Links of pages as whole addresses, and the attributes of their first tag."""
    pages = table(spark, d, "pages").withColumn("tag", F.regexp_extract("html", "<html [^>]*>", 0)).withColumn("lang", T.attributes("tag")["lang"])
    links = pages.select("page_id", "url", "lang", F.explode(T.link_targets("html")).alias("link"))
    return links.select("page_id", "link", U.absolute_url("link", "url").alias("target"), "lang")


@query("SELECT p_partkey, upper(p_name) || ' & é fi' AS decoded, sha256(p_name || '|' || p_brand || '|') AS mark FROM part")
def decoded_texts(spark, d):
    """Entities and compatibility forms made plain, and fingerprints of records."""
    wide = F.translate(F.upper("p_name"), "AEIOU", "ＡＥＩＯＵ")
    return table(spark, d, "part").select("p_partkey", U.nfkc(U.decode_entities(F.concat(wide, F.lit(" &amp; &eacute; ﬁ")))).alias("decoded"), T.fingerprint("p_name", "p_brand", F.lit(None).cast("string")).alias("mark"))


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT CAST(r AS INTEGER) AS round, (SELECT count(*) FROM c WHERE n >= r) AS n FROM (SELECT unnest(range(1, (SELECT max(n) + 1 FROM c))) AS r)")
def diversified_feed(spark, d):
    """A feed that shows each brand once per round, in another order each time; here, how many a round has."""
    feed = select.diversified(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", seed=7)
    return feed.groupBy(F.col("__round").alias("round")).agg(F.count_distinct("p_brand").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) ORDER BY c_name LIMIT 15")
def unseen_rows(spark, d):
    """The first rows whose key isn't there yet."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_name")
    return retrieval.unseen(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), rows, "k", "c_name", 15).select("c_custkey", "c_name")


@query("SELECT p_partkey, 'kind' AS section FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey, 'other' FROM part WHERE list_contains(string_split(p_name, ' '), 'red')")
def section_rows(spark, d):
    """Sections by the array that their kind names; kinds that aren't known read the tags."""
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"), F.array("p_type").alias("kinds"))
    columns = {"kind": "kinds", "tag": "tags"}
    parts = [retrieval.section(rows, kind, value, columns).select("p_partkey", F.lit(kind).alias("section")) for kind, value in (("kind", "PROMO"), ("other", "red"))]
    return parts[0].unionByName(parts[1])
