"""Queries that serve the catalogue: the view, facets, sections, paging, search. Driver tables stand in for it: orders
are works with dates, customers their sources, parts are tagged works, suppliers creators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators import resolve, retrieval, select
from curatrix.plans.registry import registry
from curatrix.sources.files import table

QUERIES, SQL, query = registry()


def part_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumn("tags", F.concat(F.split("p_name", " "), F.array("p_type")))


@query(
    """
    WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS rn FROM lineitem WHERE l_linenumber = 1)
    SELECT o_orderkey AS artwork_id, coalesce(nullif(trim(c_name), ''), 'unknown') AS artist, o_orderpriority || ', ' || o_orderstatus AS tags_text,
           l_partkey AS image_id, coalesce(l_quantity, 0.0) AS width, CAST(year(o_orderdate) AS INTEGER) AS created_year
    FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lines ON l_orderkey = o_orderkey AND rn = 1
    WHERE o_orderstatus = 'F'
    """
)
def published_view(spark, d):
    """Inner join on the source, left join on the one primary image with its predicate in the join, fallbacks."""
    orders, customer, lines = (table(spark, d, n) for n in ("orders", "customer", "lineitem"))
    primary = select.first_per_key(lines.where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"), ["l_orderkey"], "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    shown = orders.where("o_orderstatus = 'F'").join(customer, F.col("c_custkey") == F.col("o_custkey")).join(primary, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return shown.select(
        F.col("o_orderkey").alias("artwork_id"),
        F.coalesce(F.nullif(F.trim("c_name"), F.lit("")), F.lit("unknown")).alias("artist"),
        F.array_join(F.array("o_orderpriority", "o_orderstatus"), ", ").alias("tags_text"),
        F.col("l_partkey").alias("image_id"),
        F.coalesce("l_quantity", F.lit(0.0)).alias("width"),
        F.year("o_orderdate").alias("created_year"),
    )


@query("SELECT event_type, count(json_extract_string(props, '$.k')) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_payload(spark, d):
    """Values out of a JSON payload, empty as null."""
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit(""))
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k.cast("bigint")).alias("total"))


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' AS payload, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def payload_and_slug(spark, d):
    """A nested payload as JSON, and a slug."""
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("payload"), T.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def visible_children(spark, d):
    """Rows whose parent is published."""
    return table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7")
def own_rows(spark, d):
    """What a user may see: rows of their own."""
    return table(spark, d, "events").where("user_id = 7").select("event_id", "event_type", "value")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND p_type = 'ECONOMY'")
def facet_all(spark, d):
    """Works that have every chosen facet value."""
    return part_tags(spark, d).where(retrieval.has_all("tags", ["red", "ECONOMY"])).select("p_partkey", "p_name", "p_type")


@query("SELECT tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(list_append(string_split(p_name, ' '), p_type)) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 12")
def tag_count_top(spark, d):
    """The most frequent tags, ties by name."""
    return retrieval.tag_counts(part_tags(spark, d), "tags").orderBy(F.desc("n"), "tag").limit(12)


@query(
    """
    WITH t AS (SELECT count(*) FILTER (p_brand = 'Brand#99') AS by_id, count(*) FILTER (p_name LIKE '%anvil%') AS by_label FROM part)
    SELECT CASE WHEN by_id > 0 THEN by_id ELSE by_label END AS n, CASE WHEN by_id > 0 THEN 'id' ELSE 'label' END AS matched_by FROM t
    """
)
def section_fallback_count(spark, d):
    """A section's count by id, or by label where no id matches."""
    return retrieval.count_with_fallback(table(spark, d, "part"), F.col("p_brand") == "Brand#99", F.contains("p_name", F.lit("anvil")))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%gizmo%'")
def section_fallback_rows(spark, d):
    """A section's rows by id, or by label where no id matches."""
    return retrieval.rows_with_fallback(table(spark, d, "part"), F.col("p_brand") == "Brand#99", F.contains("p_name", F.lit("gizmo"))).select("p_partkey", "p_name")


_BUCKET = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split('fnv1a-v1:' || p_partkey, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 10000"


@query(f"SELECT p_partkey, CAST({_BUCKET} AS BIGINT) AS bucket FROM part")
def random_bucket(spark, d):
    """The stable bucket of each work."""
    return table(spark, d, "part").select("p_partkey", T.stable_bucket(F.col("p_partkey").cast("string")).alias("bucket"))


@query("SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def page_latest(spark, d):
    """The third page of published works, newest first, ties by key."""
    return select.page(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.desc("o_orderdate"), F.desc("o_orderkey"), skip=40).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))


@query("SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) > 30 AS has_more FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 10")
def page_has_more(spark, d):
    """A page of creators that says whether there are more."""
    return select.page_with_more(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", skip=10)


@query(f"WITH b AS (SELECT p_partkey, p_brand, CAST({_BUCKET} AS BIGINT) AS bucket FROM part) SELECT * FROM b WHERE bucket >= 2500 ORDER BY bucket, p_partkey LIMIT 30")
def random_window(spark, d):
    """A random feed: a window over (bucket, key)."""
    parts = table(spark, d, "part").withColumn("bucket", T.stable_bucket(F.col("p_partkey").cast("string")))
    return select.page(parts.where("bucket >= 2500").select("p_partkey", "p_brand", "bucket"), "bucket", "p_partkey", size=30)


_SCORE = """CASE WHEN {t} = '' THEN 0.0 WHEN {t} = '{p}' THEN 1.0 WHEN starts_with(lower({f}), '{q}') OR starts_with({t}, '{p}') THEN 0.94 WHEN contains(lower({f}), '{q}') THEN 0.88 WHEN contains({t}, '{p}') THEN 0.78 ELSE 0.0 END"""


def _score_sql(field: str, queries: list[str]) -> str:
    plain = f"regexp_replace(lower({field}), '[ _,.:/()-]', '', 'g')"
    return "greatest(" + ", ".join(_SCORE.format(t=plain, f=field, q=q, p=q.replace(" ", "").replace("-", "")) for q in queries) + ")"


@query(
    f"""
    WITH s AS (SELECT p_partkey, round(100 * {_score_sql('p_name', ['ri-ng', 'widget', 'd r'])} + 30 * {_score_sql('p_type', ['ri-ng', 'widget', 'd r'])} + 10 * {_score_sql('p_brand', ['ri-ng', 'widget', 'd r'])}, 4)::DOUBLE AS score FROM part)
    SELECT p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 40
    """
)
def search_rank(spark, d):
    """Ranked search with an alias group over weighted fields."""
    variants = retrieval.expanded("ri-ng", [["ring", "widget", "d r"]])[:1] + ["widget", "d r"]
    found = retrieval.ranked(table(spark, d, "part"), variants, {"p_name": 100.0, "p_type": 30.0, "p_brand": 10.0})
    return found.select("p_partkey", "score").orderBy(F.desc("score"), "p_partkey").limit(40)


@query(
    """
    WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS w, FROM documents)
    SELECT doc_id, count(DISTINCT w)::BIGINT AS words, count(DISTINCT substr(w, 1, 3))::BIGINT AS starts FROM w GROUP BY doc_id
    """
)
def search_terms(spark, d):
    """The inverted index of word beginnings over whole texts, measured per document: distinct words, and distinct
    beginnings of up to three letters. Counted where the text lies."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0)))
    counted = table(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    return counted.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct(F.transform("w", lambda x: F.substring(x, 1, 3)))).cast("long").alias("starts"))


@query(
    """
    SELECT p_partkey, CAST(len(list_distinct(flatten(list_transform(regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9a-z]+'), lambda w: list_transform(generate_series(1, least(12, len(w))), lambda i: substr(w, 1, i)))))) AS INTEGER) AS n_terms
    FROM part
    """
)
def index_terms(spark, d):
    """How many index terms each work has: beginnings of its Latin words, each once."""
    return table(spark, d, "part").select("p_partkey", F.size(T.index_terms("p_name", "p_type")).alias("n_terms"))


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[0-9a-z]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[0-9a-z]+'), 'from') AND list_contains(regexp_extract_all(lower(text), '[0-9a-z]+'), 'with')")
def search_and(spark, d):
    """Documents that have all words of a query, found in one scan."""
    return table(spark, d, "documents").where(retrieval.has_all_words("text", ["the", "from", "with"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(lower(text), '[0-9a-z]+'), ['the', 'from', 'with'])) = 3")
def search_index(spark, d):
    """The same through an inverted index of (term, document)."""
    index = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]+"), F.lit(0)))).alias("term"))
    return retrieval.matching_all(index, ["the", "from", "with"])


@query(
    """
    WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders)
    SELECT o_custkey AS custkey, rn AS position, o_orderkey, o_totalprice FROM l JOIN orders o USING (o_orderkey, o_custkey) WHERE rn <= 3
    """
)
def ordered_lookup(spark, d):
    """Records of a list of ids, in the list's order."""
    orders = table(spark, d, "orders")
    lists = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at"), "o_orderkey"))), lambda s: s["o_orderkey"]).alias("ids"))
    return retrieval.ordered_lookup(lists.withColumn("ids", F.slice("ids", 1, 3)), "custkey", "ids", orders.select("o_orderkey", "o_totalprice"), "o_orderkey").select("custkey", F.col("position").cast("bigint").alias("position"), "o_orderkey", "o_totalprice")


@query(
    """
    WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS round, min(p_partkey) OVER (PARTITION BY p_brand) AS seen FROM part)
    SELECT p_partkey, p_brand, CAST(row_number() OVER (ORDER BY round, seen) AS INTEGER) AS position FROM r QUALIFY position <= 60
    """
)
def round_robin(spark, d):
    """Works by brand in turn, brands in first-seen order."""
    return select.round_robin(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 60)


@query(
    """
    WITH r AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS round, min(p_partkey) OVER (PARTITION BY p_type, p_brand) AS seen FROM part)
    SELECT p_partkey, p_brand, p_type, CAST(row_number() OVER (PARTITION BY p_type ORDER BY round, seen) AS INTEGER) AS cohort_rank FROM r QUALIFY cohort_rank <= 20
    """
)
def stratified_sample(spark, d):
    """A pilot: of each type 20 works, brands in turn."""
    return select.stratified(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), "p_type", "p_brand", "p_partkey", 20)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 5")
def capped_per_key(spark, d):
    """Of each creator the first five works."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return select.capped_per_key(lines, ["l_suppkey"], 5, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").drop("l_extendedprice")


@query(
    """
    WITH RECURSIVE r AS (SELECT p_partkey, p_type, p_brand, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part),
    t AS (
        SELECT p_type, rn, p_partkey, p_brand, p_name, true AS take, [p_brand] AS brands, [p_name] AS names FROM r WHERE rn = 1
        UNION ALL
        SELECT p_type, rn, p_partkey, p_brand, p_name, ok, CASE WHEN ok THEN list_append(brands, p_brand) ELSE brands END, CASE WHEN ok THEN list_append(names, p_name) ELSE names END
        FROM (SELECT r.*, t.brands, t.names, len(list_filter(t.brands, lambda b: b = r.p_brand)) < 3 AND len(list_filter(t.names, lambda n: n = r.p_name)) < 4 AS ok FROM t JOIN r ON r.p_type = t.p_type AND r.rn = t.rn + 1)
    )
    SELECT p_partkey, p_type, p_brand, p_name FROM t WHERE take
    """
)
def greedy_two_caps(spark, d):
    """Per type, works by price under caps of 3 per brand and 4 per name."""
    parts = table(spark, d, "part").withColumn("cheapness", -F.col("p_retailprice"))
    return select.greedy_under_caps(parts, "p_type", {"p_brand": 3, "p_name": 4}, "cheapness", "p_partkey").select("p_partkey", "p_type", "p_brand", "p_name")


@query(
    """
    WITH a AS (SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') ORDER BY p_partkey LIMIT 8),
    b AS (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_partkey LIMIT 8)
    SELECT 'red' AS section, p_partkey FROM a UNION ALL SELECT 'ECONOMY', p_partkey FROM b
    """
)
def home_sections(spark, d):
    """Sections in order, none repeating an item of an earlier one."""
    rows = part_tags(spark, d).select(F.explode("tags").alias("section"), "p_partkey").where(F.col("section").isin("red", "ECONOMY"))
    return select.no_repeat_sections(rows, ["red", "ECONOMY"], "section", "p_partkey", "p_partkey", 8)


@query("SELECT url, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS clean, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS slug, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, CAST(len(regexp_extract_all(html, '<a [^>]*href=\"')) AS INTEGER) AS n_links FROM pages")
def html_listing(spark, d):
    """Crawled pages as records: address parts, title, links."""
    pages = table(spark, d, "pages")
    return pages.select("url", T.host("url").alias("host"), T.safe_url("url").alias("clean"), T.last_segment(T.safe_url("url")).alias("slug"), T.first_match("html", "(?s)<title>(.*?)</title>").alias("title"), F.size(T.link_targets("html")).alias("n_links"))


@query("SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def page_links(spark, d):
    """page, link of every anchor."""
    return table(spark, d, "pages").select("page_id", F.explode(T.link_targets("html")).alias("link"))


def _stripped(x: str) -> str:
    for pattern, flags in ((r"<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "gis"), ("<[^>]*>", "gs")):
        x = f"regexp_replace({x}, '{pattern}', ' ', '{flags}')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"


@query(
    f"""
    WITH a AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1), lambda x: {_stripped('x')}), lambda x: x <> '') AS l FROM pages)
    SELECT page_id, {_stripped('html')} AS text, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS links, {_stripped("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading FROM a
    """
)
def page_text(spark, d):
    """Visible text of pages, anchors' texts, first heading."""
    return table(spark, d, "pages").select("page_id", T.strip_html("html").alias("text"), F.array_join(T.link_texts("html"), "|").alias("links"), T.strip_html(T.first_match("html", "(?is)<h1[^>]*>(.*?)</h1>")).alias("heading"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' OR lower(s_name) LIKE '%0000042%'")
def creator_facets(spark, d):
    """Creators matching a controlled id or, by alias, a text."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.where((F.col("n_name") == "NATION_3") | retrieval.has_any("s_name", ["0000042"])).select("s_suppkey", "s_name", "n_name")


@query(
    """
    WITH n AS (SELECT 's' || s_suppkey AS lk, s_name AS ln FROM supplier), m AS (SELECT c_custkey AS rk, replace(c_name, 'Customer', 'Supplyer') AS rn FROM customer),
    p AS (SELECT lk, ln, rk, rn, round(1 - levenshtein(ln, rn) / greatest(length(ln), length(rn))::DOUBLE, 4) AS similarity FROM n, m WHERE length(ln) > 0)
    SELECT lk, rk, similarity FROM p WHERE similarity >= 0.72 QUALIFY row_number() OVER (PARTITION BY lk ORDER BY similarity DESC, rk) = 1
    """
)
def slug_similarity(spark, d):
    """The most similar name of another table, by edit distance."""
    left = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("lk"), F.col("s_name").alias("ln"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("rk"), F.replace("c_name", F.lit("Customer"), F.lit("Supplyer")).alias("rn"))
    return resolve.similar_names(left, "lk", "ln", right, "rk", "rn").select("lk", "rk", "similarity")
