"""Registered queries that run as streams with keyed state, and SQL for what they must come to."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from curatrix.functions.catalogue import ACHIEVEMENTS
from curatrix.plans.registry import registry
from curatrix.sources.files import is_folder, table
from curatrix.streaming import grants, ingest
from curatrix.streaming.library import checkpoint_folder

QUERIES, SQL, query = registry()


def stream(spark, d: str, name: str):
    """The table as a stream of its files: its folder, or its parent narrowed to the table's name."""
    path = f"{d}/{name}.parquet"
    schema = Ty.StructType(table(spark, d, name).schema.fields)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if is_folder(spark, path) else f"{d}/{name}*")


def _granted(spark, d):
    """Clicks are favourites, sign-ups followed creators, views the history; a purchase above 50 asks for a title with a
    reference, another one without. Accounts below zero are closed."""
    kind = F.col("event_type")
    metric = F.when(kind == "click", "favorite_unique_count").when(kind == "signup", "followed_artist_unique_count").when(kind == "view", "history_unique_count")
    item = F.when(kind == "view", F.col("event_id").cast("string")).otherwise(F.floor("value").cast("string"))
    manual = kind == "purchase"
    requests = stream(spark, d, "events").select(
        "user_id", metric.alias("metric"), item.alias("item_id"), F.col("ts").cast("timestamp").alias("updated_at"), F.lit(False).alias("deleted"), "event_id",
        F.when(manual, "learned_all_ages").alias("achievement_id"), F.when(manual & (F.col("value") > 50), F.concat(F.lit("case "), "event_id")).alias("reference"),
    )
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") < 0, "deleted").alias("account_status"))
    folder = checkpoint_folder(spark)
    grants.run(requests, accounts, folder)
    return grants.granted(spark, folder)


_GRANTED = f"""
    m AS (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'click' THEN floor(value) END) AS favorite_unique_count, count(DISTINCT CASE WHEN event_type = 'signup' THEN floor(value) END) AS followed_artist_unique_count,
                 count(DISTINCT CASE WHEN event_type = 'view' THEN event_id END) AS history_unique_count, max(CASE WHEN event_type = 'purchase' THEN value END) AS asked
          FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal >= 0 GROUP BY 1),
    g AS ({" UNION ALL ".join(f"SELECT user_id, '{name}' AS achievement_id, '{kind}' AS grant_type FROM m WHERE " + (f"{metric} >= {least}" if kind == "automatic" else "asked > 50" if kind == "manual" else "true") for name, (_, kind, metric, least, _) in ACHIEVEMENTS.items())})
"""


@query(f"WITH {_GRANTED} SELECT user_id, achievement_id, grant_type FROM g")
def stream_grants(spark, d):
    """Achievements that a stream of requests grants, each once."""
    return _granted(spark, d).select("user_id", "achievement_id", "grant_type")


@query(f"WITH {_GRANTED}, n AS (SELECT achievement_id, count(*) AS n FROM g GROUP BY 1) SELECT a AS achievement_id, coalesce(n, 0)::BIGINT AS unlocked, (SELECT count(*) FROM m) AS active_users FROM (VALUES {', '.join(f'({chr(39)}{a}{chr(39)})' for a in ACHIEVEMENTS)}) a(a) LEFT JOIN n ON a = achievement_id")
def grant_statistics(spark, d):
    """Counters over the ledger of grants."""
    return grants.statistics(_granted(spark, d))


@query(
    r"""
    WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.|m\.)?', ''), '[?#].*$', '') AS key, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
    f AS (SELECT *, CASE WHEN key = '' THEN 'no key' WHEN title = '' THEN 'no title' WHEN length(title) < 12 THEN 'short title' END AS reason FROM p)
    SELECT page_id, key, reason, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN page_id = min(CASE WHEN reason IS NULL THEN page_id END) OVER (PARTITION BY key) THEN 'accepted' ELSE 'skipped' END AS outcome FROM f
    """
)
def stream_ingest(spark, d):
    """Pages taken once by address, from a stream of files with history; untitled ones fail, copies are skipped."""
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^https?://(www\.|m\.)?", ""), "[?#].*$", "")
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    reason = F.when(title == "", "no title").when(F.length(title) < 12, "short title")
    pages = stream(spark, d, "pages")
    rows = ingest.outcomes(pages.select("page_id", key.alias("key"), reason.alias("reason")), F.col("key"), F.col("page_id"), F.col("reason"))
    folder = checkpoint_folder(spark)
    schema = ingest.run(spark, rows, folder)
    return ingest.results(spark, folder, schema).select("page_id", "key", "reason", "outcome")
