"""Queries that bring records into the shapes of their kinds: snapshots, exports, museum candidates, addresses, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import media as M
from curatrix.functions import museum
from curatrix.functions import shapes as S
from curatrix.functions import text as T
from curatrix.functions import titles
from curatrix.functions import unicode as U
from curatrix.operators import release, resolve
from curatrix.plans.registry import registry
from curatrix.sources.files import table

QUERIES, SQL, query = registry()


def _works(spark, d):
    """Parts as raw works, with padding, gaps and long values."""
    return table(spark, d, "part").select(
        F.when(F.col("p_size") > 25, "").otherwise(F.concat(F.lit("w"), F.col("p_partkey").cast("string"))).alias("_id"),
        F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("id"),
        F.repeat("p_name", F.lit(30)).alias("title"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("  "), F.col("p_name"))).alias("title_cn"),
        F.col("p_brand").alias("artist"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("medium"),
        F.concat(F.array(F.lit(" "), F.col("p_type")), F.split("p_name", " ")).alias("tags"),
        F.concat_ws("；", "p_type", "p_name").alias("tags_text"),
        F.when(F.col("p_size") > 20, F.concat(F.lit("https://x.y/"), F.col("p_size").cast("string"))).alias("display_url"),
    )


_WORKS = """w AS (SELECT CASE WHEN p_size > 25 THEN '' ELSE 'w' || p_partkey END AS _id, ' ' || p_partkey AS id, repeat(p_name, 30) AS title, CASE WHEN p_size > 10 THEN '  ' || p_name END AS title_cn, p_brand AS artist,
    CASE WHEN p_type <> 'PROMO' THEN p_type END AS medium, list_concat([' ', p_type], string_split(p_name, ' ')) AS tags, p_type || '；' || p_name AS tags_text, CASE WHEN p_size > 20 THEN 'https://x.y/' || p_size END AS display_url FROM part)"""


@query(
    f"""
    WITH {_WORKS}
    SELECT trim(coalesce(nullif(_id, ''), id)) AS _id, trim(id) AS id, substr(trim(title), 1, 240) AS title, coalesce(trim(title_cn), '') AS "titleCn", artist, coalesce(medium, '') AS medium, array_to_string(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''), ',') AS tags, coalesce(display_url, '') AS display_url FROM w
    """
)
def work_snapshots(spark, d):
    """Works as users' libraries keep them."""
    out = S.shaped(_works(spark, d), S.WORK_SNAPSHOT)
    return out.select("_id", "id", "title", "titleCn", "artist", "medium", F.array_join("tags", ",").alias("tags"), "display_url")


@query(
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS id, substr(trim(repeat(s_name, 40)), 1, 240) AS "nameZh", CAST(greatest(floor(s_acctbal), 0) AS BIGINT) AS "artworkCount", CASE WHEN s_acctbal > 5000 THEN 'https://p/' || s_suppkey ELSE '' END AS "portraitUrl", CASE WHEN s_acctbal > 5000 THEN substr(trim(repeat(s_name || ' ', 40)), 1, 500) ELSE '' END AS "portraitCredit", CASE WHEN s_acctbal > 5000 THEN 'w' || s_nationkey ELSE '' END AS "portraitArtworkId", 1 AS "portraitSnapshotVersion",
           CASE WHEN s_acctbal > 5000 THEN 'approved' ELSE 'pending' END AS "portraitStatus" FROM supplier
    """
)
def artist_snapshots(spark, d):
    """Creators as libraries keep them; portraits only where approved."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), F.repeat("s_name", F.lit(40)).alias("name_zh"), F.col("s_acctbal").alias("artworkCount"), F.concat(F.lit(" https://p/"), F.col("s_suppkey").cast("string")).alias("portrait_url"), F.repeat(F.concat("s_name", F.lit(" ")), F.lit(40)).alias("portrait_credit"), F.concat(F.lit("w"), "s_nationkey").alias("portrait_artwork_id"), F.when(F.col("s_acctbal") > 5000, "approved ").otherwise("pending").alias("portrait_status"))
    with_portrait = rows.select("_id", "name_zh", "artworkCount", *S.portrait_fields(rows).values())
    return S.shaped(with_portrait, S.ARTIST_SNAPSHOT).select("id", "nameZh", "artworkCount", "portraitUrl", "portraitCredit", "portraitArtworkId", "portraitStatus", "portraitSnapshotVersion")


@query(
    f"""
    WITH {_WORKS}, t AS (SELECT *, list_filter(list_transform(list_concat(tags, string_split_regex(tags_text, '[,，；、\\s]+')), lambda x: trim(x)), lambda x: x <> '') AS l FROM w)
    SELECT trim(id) AS supabase_id, coalesce(trim(title_cn), '未命名作品') AS title_cn, artist, medium, display_url AS thumbnail_url, display_url, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM t
    """
)
def exported_works(spark, d):
    """Rows of the view as documents, tags from a list and a text."""
    works = _works(spark, d)
    return S.shaped(works, S.EXPORTED_WORK, F.array_join(S.exported_tags("tags", "tags_text"), ",").alias("tags")).select("supabase_id", "title_cn", "artist", "medium", "thumbnail_url", "display_url", "tags")


@query(
    f"""
    WITH {_WORKS} SELECT coalesce(nullif(_id, ''), id) AS _id, title, coalesce(title_cn, title) AS "titleCn", coalesce(title_cn, '未命名作品') AS shown, coalesce(medium, '材质暂未收录') AS "shownMedium", coalesce(display_url, '') AS "shownUrl", '未知收藏地' AS "shownPlace" FROM w
    """
)
def client_works(spark, d):
    """Works in a device's lists, and as a page shows them."""
    works = _works(spark, d)
    both = S.shaped(works, {"_id": S.COMPACT_WORK["_id"], "title": S.COMPACT_WORK["title"], "titleCn": S.COMPACT_WORK["titleCn"], "shown": S.SHOWN_WORK["title"], "shownMedium": S.SHOWN_WORK["medium"], "shownUrl": S.SHOWN_WORK["thumbnailUrl"], "shownPlace": S.SHOWN_WORK["location"]})
    return both


@query(
    """
    SELECT p_partkey, 'pending' AS review_status, 'https://a/' || p_partkey AS url, p_name AS title_en, p_type AS file_format, CASE WHEN p_size > 25 THEN 'i' || p_partkey ELSE lpad(CAST(p_size AS VARCHAR), 3, '0') || '_standard' END AS image_id FROM part
    """
)
def evidence_records(spark, d):
    """Crawled works as evidence for review."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://a/"), F.col("p_partkey").cast("string")).alias("source_url"), F.col("p_name").alias("title_en"), F.col("p_type").alias("medium"), F.when(F.col("p_size") > 25, F.concat(F.lit("i"), F.col("p_partkey").cast("string"))).alias("image_id"), M.asset_name("p_size").alias("asset_name"))
    return S.evidence_record(rows, "site", "p_partkey").select("p_partkey", "review_status", F.col("source.url").alias("url"), F.col("raw.title_en").alias("title_en"), F.col("raw.file_format").alias("file_format"), F.col("image.id").alias("image_id"))


@query("SELECT event_id, replace(replace(props, ': ', ': '), ' ', '') AS props FROM events")
def plain_numbers(spark, d):
    """Payloads whose wrapped numbers are made plain again."""
    wrapped = F.regexp_replace(F.regexp_replace("props", " ", ""), r":(-?[0-9]+)", r': {"\$numberInt": "$1"}')
    return table(spark, d, "events").select("event_id", F.replace(S.plain_numbers(wrapped), F.lit(" "), F.lit("")).alias("props"))


_MUSEUM = """
    a AS (SELECT 'cma' AS source, p_partkey AS n, p_name AS title, p_brand || ' (b. 1850)' AS artist, '' AS place, p_type AS kind FROM part WHERE p_brand = 'Brand#11' AND p_type <> 'PROMO' AND p_size > 10),
    b AS (SELECT 'met', p_partkey, p_name, p_brand, p_type || '; ' || p_name, p_type FROM part WHERE p_brand = 'Brand#11' AND p_size % 2 = 0 AND p_retailprice < 1500),
    c AS (SELECT 'aic', p_partkey, p_name, p_brand, '', p_type FROM part WHERE p_brand = 'Brand#11' AND p_size > 5)
"""


@query(f"WITH {_MUSEUM}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT source || ':' || n AS key, title, artist, place, kind AS classification, sha256('brand 11|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|1889') AS fingerprint FROM u")
def museum_candidates(spark, d):
    """Records of three museums as candidates of one creator."""
    parts = table(spark, d, "part")
    no = F.lit(None).cast("string")
    creators = F.array(F.struct(F.lit("Somebody else").alias("description"), F.lit("artist").alias("qualifier")), F.struct(F.concat("p_brand", F.lit(" (b. 1850)")).alias("description"), F.when(F.col("p_size") > 10, "").otherwise("after").alias("qualifier")))
    cma = parts.select(F.col("p_partkey").alias("id"), creators.alias("creators"), F.lit("CC0").alias("share_license_status"), F.lit("https://i").alias("print_url"), F.when(F.col("p_type") == "PROMO", "Book").otherwise(F.col("p_type")).alias("type"), no.alias("department"), no.alias("url"), F.col("p_size").cast("string").alias("accession_number"), F.col("p_name").alias("title"), F.lit("c. 1889").alias("creation_date"), F.array().cast("array<string>").alias("culture"), F.lit(" ").alias("current_location"), no.alias("technique"), no.alias("measurements"))
    met = parts.select(F.col("p_partkey").alias("objectID"), (F.col("p_size") % 2 == 0).alias("isPublicDomain"), F.lit("https://i").alias("primaryImage"), F.col("p_brand").alias("artistDisplayName"), F.when(F.col("p_retailprice") >= 1500, "Workshop of").otherwise(" ").alias("artistPrefix"), F.lit("Painter").alias("artistRole"), F.lit("painting").alias("objectName"), F.col("p_type").alias("classification"), no.alias("department"), no.alias("objectURL"), F.col("p_name").alias("title"), F.lit("1889").alias("objectDate"), F.col("p_type").alias("culture"), F.col("p_name").alias("country"), F.col("p_type").alias("city"), no.alias("medium"), no.alias("dimensions"))
    aic = parts.select(F.col("p_partkey").alias("id"), F.lit(True).alias("is_public_domain"), F.when(F.col("p_size") > 5, "img").otherwise("").alias("image_id"), F.col("p_brand").alias("artist_title"), F.col("p_brand").alias("artist_display"), F.lit("painting").alias("artwork_type_title"), F.col("p_type").alias("classification_title"), no.alias("department_title"), no.alias("api_link"), F.col("p_name").alias("title"), F.lit("1889").alias("date_display"), no.alias("place_of_origin"), no.alias("medium_display"), no.alias("dimensions"))
    found = museum.candidates(museum.cleveland(cma, "Brand#11"), museum.metropolitan(met, "Brand#11"), museum.chicago(aic, "Brand#11", "https://iiif"))
    return found.select("key", "title", "artist", "place", F.array_join("classification", ",").alias("classification"), "fingerprint")


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0') ELSE CAST(o_orderkey AS VARCHAR) END || '_standard.jpg' AS asset, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp, 'derivatives/thumb/' || regexp_replace(o_orderpriority, '[^a-zA-Z0-9._-]', '-', 'g') || '.webp' AS thumb FROM orders
    """
)
def asset_names(spark, d):
    """Names of stored images, time stamps, paths of derived forms."""
    return table(spark, d, "orders").select("o_orderkey", M.asset_name("o_orderkey").alias("asset"), M.csv_timestamp("o_orderdate").alias("stamp"), M.derivative_paths("o_orderpriority")[0].alias("thumb"))


@query(
    """
    WITH u AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'https://other/x.jpg' ELSE 'https://store/full/' || CASE WHEN p_size > 20 THEN p_size || '_standard' ELSE 'old' || p_size END || '.jpg?v=1' END AS url FROM part), o AS (SELECT p_partkey, url, CASE WHEN url LIKE 'https://store%' THEN regexp_replace(url, '[?].*$', '') ELSE '' END AS original FROM u)
    SELECT p_partkey, original, CASE WHEN original = '' THEN NULL WHEN original LIKE '%_standard.jpg' THEN 'https://store/thumb/' || regexp_extract(original, '/([^/]*)\\.jpg$', 1) || '.webp' ELSE original END AS thumbnail_url, true AS direct FROM o
    """
)
def image_urls(spark, d):
    """Originals of the store, and the addresses a row should have."""
    rows = table(spark, d, "part").withColumn("url", F.when(F.col("p_size") > 40, "https://other/x.jpg").otherwise(F.concat(F.lit("https://store/full/"), F.when(F.col("p_size") > 20, F.concat(F.col("p_size").cast("string"), F.lit("_standard"))).otherwise(F.concat(F.lit("old"), F.col("p_size").cast("string"))), F.lit(".jpg?v=1"))))
    rows = rows.withColumn("original", M.original_image("store", "/full/", "url"))
    patch = M.image_patch(F.col("original"), "/thumb/", "/display/", F.col("url"), F.col("url"), F.col("url"))
    return rows.select("p_partkey", "original", patch["thumbnail_url"].alias("thumbnail_url"), M.is_direct_media("url").alias("direct"))


@query(
    """
    SELECT p_partkey, p_name || ' pl' AS series, lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS artist, p_type = 'PROMO' OR p_size > 40 OR p_name LIKE '%plate%' AS derivative, p_name LIKE '%red%' AS relevant FROM part
    """
)
def series_titles(spark, d):
    """Titles without plate numbers, plain creators, derived works, and whether a listing answers a query."""
    rows = table(spark, d, "part").withColumn("title", F.concat("p_name", F.lit(" Pl. No "), F.col("p_size").cast("string"))).withColumn("tags", F.array(F.when(F.col("p_size") > 40, "After it").otherwise("x"), F.when(F.col("p_type") == "PROMO", "Posters").otherwise("aftermath")))
    return rows.select("p_partkey", titles.series_title("title").alias("series"), titles.series_artist(F.concat(F.lit("Follower of "), "p_brand", F.lit(" (1850)"))).alias("artist"), titles.is_derivative("p_name", "p_brand", "tags").alias("derivative"), titles.is_relevant("p_name", F.lit("The Red One"), {"red one": "red", "blue": "blue"}).alias("relevant"))


@query(
    """
    WITH s AS (SELECT trim(p_type || ' ' || p_brand) AS query, max(p_size) AS priority, min(p_partkey) AS first_at FROM part GROUP BY 1), f AS (SELECT lower(query) AS k, arg_min(query, (-priority, first_at)) AS query, max(priority) AS priority FROM s GROUP BY 1)
    SELECT query, priority FROM f
    """
)
def search_seeds(spark, d):
    """Queries of a list of seeds, each once, of most priority."""
    seeds = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_type", "p_brand").alias("query")).agg(F.max("p_size").alias("priority"), F.min("p_partkey").alias("at"))
    best = seeds.withColumn("query", T.squeeze("query")).where("query <> ''").groupBy(F.lower("query").alias("k")).agg(F.min_by("query", F.struct(-F.col("priority"), "at")).alias("query"), F.max("priority").alias("priority"))
    return best.select("query", "priority")


@query("SELECT page_id, regexp_matches(html, '(?i)<title>\\s*(Site\\s+)?Under Maintenance\\b') OR regexp_matches(html, '(?i)\\bOur website is currently undergoing scheduled maintenance\\b') AS maintenance FROM pages")
def maintenance_pages(spark, d):
    """Pages that only say that the site is down."""
    return table(spark, d, "pages").select("page_id", M.is_maintenance_page("html").alias("maintenance"))


@query(
    """
    SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || p_size || 'shiji-hua' AS slug, p_name AS label, 'style-candidate-' || substr(sha1(p_name), 1, 10) AS candidate FROM part
    """
)
def transliterated_slugs(spark, d):
    """Slugs of mixed scripts, labels as shown, ids of new terms."""
    letters = {"世": "shi", "纪": "ji", "画": "hua"}
    text = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("世纪画"))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(titles.transliterated(text, letters), "shi-ji", "shiji").alias("slug"), titles.display_label(F.concat(F.lit(" 、"), F.replace("p_name", F.lit(" "), F.lit("　 ")), F.lit(";；"))).alias("label"), titles.candidate_id(F.lit("style"), "p_name").alias("candidate"))


@query("SELECT doc_id, contains(lower(text), 'unknown') OR regexp_matches(text, '未知|暂不明确|作者未|可能|疑似|风格|待考|相关作者|归属未定') AS uncertain FROM documents")
def uncertain_texts(spark, d):
    """Texts that leave an attribution open."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(resolve.is_uncertain("text"), F.lit(False)).alias("uncertain"))


@query(
    """
    WITH k AS (SELECT s_suppkey, lower(trim(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS artist, lower(r) AS title FROM supplier, (VALUES ('Café Nuit'), ('La Nuit')) v(r))
    SELECT s_suppkey, replace(title, 'é', 'e') AS title, artist || '|' || replace(title, 'é', 'e') AS key FROM k
    """
)
def dedupe_keys(spark, d):
    """Keys of works by creator and title, however written."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.explode(F.array(F.lit("The Café (study) Nuit"), F.lit("La Nuit"))).alias("title"))
    return rows.select("s_suppkey", T.dedupe_title("title").alias("title"), T.dedupe_key("title", F.concat(F.lit("某人（"), "s_name", F.lit("，1850-1900）"))).alias("key"))


@query(
    """
    WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(list_concat(['梵', '高'], list_distinct(w)), ',') AS query_terms, '梵,高,梵高' AS grams FROM (SELECT p_partkey, [w[1]] AS w FROM t)
    """
)
def term_lists(spark, d):
    """Terms of queries, and pieces of Chinese words."""
    return table(spark, d, "part").select("p_partkey", F.array_join(T.query_terms(F.concat(F.lit("梵·高 "), F.element_at(F.split("p_name", " "), 1))), ",").alias("query_terms"), F.array_join(T.cjk_grams(F.lit("梵高")), ",").alias("grams"))


@query(
    """
    SELECT s_suppkey, CASE WHEN s_acctbal > 6000 THEN 'after' WHEN s_acctbal > 3000 THEN 'workshop' ELSE 'creator' END AS role, s_name || ' (A. B)|' || s_name || '|A. B' AS parts FROM supplier
    """
)
def relation_roles(spark, d):
    """What a creator's text says of the relation, and the names in it."""
    text = F.concat(F.when(F.col("s_acctbal") > 6000, "After ").when(F.col("s_acctbal") > 3000, "Studio of ").otherwise(""), "s_name")
    from curatrix.functions.rules import name_parts

    return table(spark, d, "supplier").select("s_suppkey", T.relation_role(text).alias("role"), F.array_join(name_parts(F.concat("s_name", F.lit(" (A. B)"))), "|").alias("parts"))


@query()
def lookup_texts(spark, d):
    """Texts as names are looked up in them; SQL has no compatibility forms, so a test compares all rows with brute force."""
    return table(spark, d, "documents").select("doc_id", F.md5(U.lookup_text("text")).alias("lookup"))


@query(
    """
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 50000 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE o_orderdate END AS updated_at FROM orders
    """
)
def touched_rows(spark, d):
    """Time stamps set where a row changed."""
    before = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 50000, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    after = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return release.touched(before, after, "o_orderkey", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
