"""Registered searches over typed texts, with SQL that compares every pair of terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import fuzzy
from curatrix.plans.registry import registry
from curatrix.sources.files import table

QUERIES, SQL, query = registry()

# DuckDB measures edits in bytes, and the queries are ASCII: every other character counts as one byte that none of them has
_MATCHED = r"""
    p AS (SELECT field, key, t AS term, count(*) AS tf FROM (SELECT field, key, unnest(found) AS t FROM told) GROUP BY ALL),
    s AS (SELECT field, sum(len(list_distinct(found))) / count(*) AS mean, count(*) AS n FROM told GROUP BY field),
    l AS (SELECT field, key, len(list_distinct(found)) AS length FROM told),
    r AS (SELECT term, field, count(*) AS rows_with FROM p GROUP BY ALL),
    d AS (SELECT DISTINCT term, regexp_replace(term, '[^\x00-\x7f]', chr(1), 'g') AS plain FROM p),
    a AS (SELECT DISTINCT asked, least(floor(length(asked) * 0.2 + 0.5), 6) AS edits FROM q),
    c AS (SELECT asked, term, length(term) AS n, starts_with(term, asked) AS begun, CASE WHEN starts_with(term, asked) THEN length(term) - length(asked) ELSE levenshtein(plain, asked) END AS distance, edits
          FROM a JOIN d ON starts_with(term, asked) OR (abs(length(plain) - length(asked)) <= edits AND levenshtein(plain, asked) <= edits)),
    m AS (SELECT asked, term, CASE WHEN begun AND distance = 0 THEN 1.0::DOUBLE WHEN begun THEN 0.375::DOUBLE * n / (n + 0.3::DOUBLE * distance) ELSE 0.45::DOUBLE * n / (n + distance) END AS weight FROM c),
    o AS (SELECT query, key, asked, sum(boost * weight * ln(1 + (n - rows_with + 0.5::DOUBLE) / (rows_with + 0.5::DOUBLE)) * (0.5::DOUBLE + tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.7::DOUBLE + 0.7::DOUBLE * length / mean)))) AS score
          FROM q JOIN m USING (asked) JOIN p USING (term) JOIN r USING (term, field) JOIN l USING (field, key) JOIN s USING (field) JOIN b USING (field) GROUP BY ALL),
    w AS (SELECT query, key, round(sum(score) * count(*), 6) AS score FROM o GROUP BY ALL),
    k AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INTEGER AS rank FROM w)
"""
_TERMS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[\n\r\p{{Z}}\p{{P}}]+'), lambda t: t <> '')"


def _typed(text: F.Column) -> F.Column:
    """What someone might type of a text: its first two Latin words of five letters or more, the first with its third letter
    left out, the second without its end."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), F.lit(0))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return F.concat_ws(" ", F.concat(F.substring(first, 1, 2), F.substr(first, F.lit(4))), F.substr(second, F.lit(1), F.length(second) - 1))


@query(
    rf"""
    WITH told AS (SELECT 'text' AS field, doc_id AS key, {_TERMS.format('text')} AS found FROM documents),
    b AS (SELECT 'text' AS field, 1.0::DOUBLE AS boost),
    h AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{5,}}') AS h FROM benchmark),
    q AS (SELECT DISTINCT item_id AS query, unnest(list_filter([substr(h[1], 1, 2) || substr(h[1], 4), substr(h[2], 1, length(h[2]) - 1)], lambda x: x IS NOT NULL)) AS asked FROM h),
    {_MATCHED}
    SELECT query AS item_id, key AS doc_id, score, rank FROM k WHERE rank <= 10
    """
)
def fuzzy_search(spark, d):
    """The ten best documents for a mistyped and a broken-off word of each benchmark item, over whole texts."""
    index = fuzzy.Index(table(spark, d, "documents"), "doc_id", {"text": F.col("text")})
    typed = table(spark, d, "benchmark").select("item_id", _typed(F.col("text")).alias("typed"))
    return fuzzy.searched(index, typed, "item_id", "typed", {}, best=10).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), "score", "rank")


@query(
    rf"""
    WITH named AS (SELECT p_partkey, p_name, p_brand, p_type, list_filter(string_split_regex(lower(p_name), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+'), lambda t: t <> '') AS n FROM part),
    f AS (SELECT p_partkey, unnest([{{'field': 'title', 'text': p_name}}, {{'field': 'artist', 'text': p_brand}}, {{'field': 'medium', 'text': p_type}}, {{'field': 'alias', 'text': array_to_string(list_concat(n, list_transform(range(1, len(n)), lambda i: n[i] || n[i + 1]), CASE WHEN len(n) > 2 THEN [array_to_string(n, '')] ELSE [] END), ' ')}}]) AS f FROM named),
    told AS (SELECT f.field AS field, p_partkey AS key, {_TERMS.format('f.text')} AS found FROM f),
    b AS (FROM (VALUES ('title', 3.0::DOUBLE), ('artist', 2.0::DOUBLE), ('medium', 1.0::DOUBLE), ('alias', 2.0::DOUBLE)) b(field, boost)),
    q AS (SELECT DISTINCT s_suppkey AS query, unnest(list_distinct({_TERMS.format("replace(p_name, ' ', '') || ' ' || substr(p_brand, 2)")})) AS asked FROM supplier JOIN part ON p_partkey = s_suppkey * 3 + 1),
    {_MATCHED}
    SELECT query AS s_suppkey, key AS p_partkey, score, rank FROM k WHERE rank <= 5
    """
)
def typed_search(spark, d):
    """Works by titles typed without spaces and makers with a letter missing, over boosted fields and compact aliases."""
    works = table(spark, d, "part")
    index = fuzzy.Index(works, "p_partkey", {"title": F.col("p_name"), "artist": F.col("p_brand"), "medium": F.col("p_type"), "alias": F.array_join(fuzzy.compact_aliases("p_name"), " ")}, buckets=16, classes=True)
    owners = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3 + 1).alias("p_partkey"))
    typed = owners.join(works, "p_partkey").select("s_suppkey", F.concat(F.regexp_replace("p_name", " ", ""), F.lit(" "), F.substring("p_brand", 2, 100)).alias("typed"))
    return fuzzy.searched(index, typed, "s_suppkey", "typed", {"title": 3.0, "artist": 2.0, "alias": 2.0}, best=5).select(F.col("query").alias("s_suppkey"), F.col("key").alias("p_partkey"), "score", "rank")


@query(f"WITH p AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS t FROM documents) GROUP BY ALL) SELECT term, count(*)::BIGINT AS n_documents, sum(tf)::BIGINT AS n_times FROM p GROUP BY term")
def stored_terms(spark, d):
    """Per term of the stored index its documents and occurrences; the buckets serve the aggregation without a shuffle."""
    index = fuzzy.Index(table(spark, d, "documents"), "doc_id", {"text": F.col("text")})
    return index.postings.groupBy("term").agg(F.count("*").alias("n_documents"), F.sum("tf").alias("n_times"))
