"""Queries over user libraries: last-writer state, per-device counters, achievements, recent lists, streams. Events
stand in for mutations: an item is an event type of a user, an error deletes, three devices report the JSON value."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from curatrix.functions import text as T
from curatrix.operators import rollup
from curatrix.plans.registry import registry
from curatrix.sources.files import is_folder, table
from curatrix.streaming import library

QUERIES, SQL, query = registry()


def as_mutations(events):
    """One item per user and fifth of the value range; times cut to minutes, so that there are ties."""
    return events.select(
        "event_id",
        "user_id",
        (F.col("event_id") % 4).cast("string").alias("item_id"),
        (F.col("event_id") % 3).cast("string").alias("device_id"),
        F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("updated_at"),
        (F.col("event_type") == "error").alias("deleted"),
        F.get_json_object("props", "$.k").cast("long").alias("device_count"),
    )


_MUT = "m AS (SELECT event_id, user_id, CAST(event_id % 4 AS VARCHAR) AS item_id, CAST(event_id % 3 AS VARCHAR) AS device_id, date_trunc('minute', ts) AS t, event_type = 'error' AS deleted, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_STATE = f"WITH {_MUT} SELECT user_id, item_id, arg_max(deleted, (t, deleted, event_id)) AS deleted, arg_max(event_id, (t, deleted, event_id)) AS event_id, CAST(epoch(max(t)) AS BIGINT) AS logged FROM m GROUP BY ALL"


def _shown(state):
    return state.select("user_id", "item_id", "deleted", "event_id", F.unix_seconds("updated_at").alias("logged"))


@query(_STATE)
def lww_state(spark, d):
    """The library's state by last writer; on equal times a deletion wins."""
    return _shown(library.latest_state(as_mutations(table(spark, d, "events"))))


@query(f"WITH {_MUT}, c AS (SELECT user_id, item_id, device_id, max(k) AS k FROM m GROUP BY ALL) SELECT user_id, item_id, sum(k)::BIGINT AS total FROM c GROUP BY ALL")
def gcounter(spark, d):
    """Counters merged over devices: each device's largest report, summed."""
    return library.total_counts(library.device_counts(as_mutations(table(spark, d, "events"))))


@query(_STATE)
def library_stream(spark, d):
    """The same state from a stream of the events, in micro-batches."""
    schema = Ty.StructType(table(spark, d, "events").schema.fields)
    stream = as_mutations(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_path(spark, d)))
    out = []
    library.stream_state(stream, library.checkpoint_folder(spark), out.append)
    return _shown(out[0])


def _stream_path(spark, d: str) -> str:
    """A stream reads folders: the table if it is one, else its parent narrowed to the table's name."""
    return f"{d}/events.parquet" if is_folder(spark, f"{d}/events.parquet") else f"{d}/events*"


@query("SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 24 HOUR THEN 'kept' ELSE 'future' END AS verdict FROM events")
def future_guard(spark, d):
    """Mutations dated too far in the future set aside; the clock is fixed here."""
    rows = table(spark, d, "events").withColumn("updated_at", F.col("ts"))
    kept, future = library.split_future(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return kept.select("event_id", F.lit("kept").alias("verdict")).unionByName(future.select("event_id", F.lit("future").alias("verdict")))


#: achievement, metric, threshold.
ACHIEVEMENTS = [("first-views", "views", 1), ("many-views", "views", 15), ("collector", "buys", 10), ("explorer", "days", 20), ("regular", "days", 25)]
_METRICS = "m AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id)"
_DEFS = "(VALUES " + ", ".join(f"('{a}', '{m}', {t})" for a, m, t in ACHIEVEMENTS) + ") AS a(achievement, metric, threshold)"


def _unlocked(spark, d):
    metrics = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("buys"), F.count_distinct(F.to_date("ts")).alias("days"))
    return metrics, rollup.thresholds_met(metrics, "user_id", spark.createDataFrame(ACHIEVEMENTS, "achievement string, metric string, threshold long"))


@query(f"WITH {_METRICS} SELECT user_id, achievement FROM m JOIN {_DEFS} ON CASE metric WHEN 'views' THEN views WHEN 'buys' THEN buys ELSE days END >= threshold")
def achievements(spark, d):
    """Thresholds that users have reached."""
    return _unlocked(spark, d)[1]


@query(
    f"""
    WITH {_METRICS}, u AS (SELECT achievement, count(*) AS n FROM m JOIN {_DEFS} ON CASE metric WHEN 'views' THEN views WHEN 'buys' THEN buys ELSE days END >= threshold GROUP BY 1)
    SELECT a.achievement, coalesce(n, 0) AS n, printf('%.2f%%', coalesce(n, 0) * 100.0 / (SELECT count(*) FROM m)) AS rate FROM {_DEFS} LEFT JOIN u ON u.achievement = a.achievement
    """
)
def unlock_rates(spark, d):
    """How many users have each achievement, those that none has too."""
    metrics, unlocked = _unlocked(spark, d)
    definitions = spark.createDataFrame(ACHIEVEMENTS, "achievement string, metric string, threshold long").select("achievement")
    counts = definitions.join(unlocked.groupBy("achievement").agg(F.count("*").alias("n")), "achievement", "left").select("achievement", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.crossJoin(F.broadcast(metrics.agg(F.count("*").alias("active")))).select("achievement", "n", T.unlock_rate(F.col("n"), F.col("active")).alias("rate"))


@query("SELECT user_id, round(100.0 * least(count(*) FILTER (event_type = 'view'), 16) / 16, 2)::DOUBLE AS percent FROM events GROUP BY user_id")
def progress(spark, d):
    """Progress to a target, clamped."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views")).select("user_id", rollup.progress(F.col("views"), F.lit(16)).alias("percent"))


@query(
    """
    WITH l AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS item, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT user_id, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t DESC, item) AS INTEGER) AS position FROM l QUALIFY position <= 8
    """
)
def recent_list(spark, d):
    """Items viewed last, each once."""
    views = table(spark, d, "events").where("event_type = 'view'").withColumn("item", F.floor("value"))
    return library.recent_items(views, "user_id", "item", "ts", most=8).select("user_id", "item", "position")


@query("SELECT user_id, CAST(floor(value) AS BIGINT) AS item, count(*) % 2 = 1 AS is_member FROM events WHERE event_type = 'click' GROUP BY ALL")
def toggle_state(spark, d):
    """Membership after toggles."""
    return library.toggled(table(spark, d, "events").where("event_type = 'click'").withColumn("item", F.floor("value")), ["user_id", "item"])


@query(
    """
    WITH t AS (SELECT event_id, user_id, CAST(floor(epoch(date_trunc('hour', ts))) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
    SELECT event_id, CAST(max(t - rn) OVER (PARTITION BY user_id ORDER BY event_id) + rn AS BIGINT) AS logged_at FROM t
    """
)
def monotone_clock(spark, d):
    """A log's clock that never stands still or runs back."""
    events = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return library.monotone_clock(events, ["user_id"], "event_id", "hour").select("event_id", "logged_at")


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 20 AS BIGINT) AS chunk FROM events")
def sync_chunks(spark, d):
    """Batches of 20 mutations per user."""
    return library.chunks(table(spark, d, "events"), ["user_id"], "event_id", 20).select("event_id", "chunk")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, count(*) AS n FROM events GROUP BY 1")
def hourly_counts(spark, d):
    """Events per hour."""
    counted = library.windowed_counts(table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at")
    return counted.select(F.unix_seconds("window_start").alias("window_start"), "n")


@query(
    """
    WITH b AS (SELECT unnest([0, 1, 2, 3]) AS k), w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS s FROM events, b)
    SELECT CAST(epoch(s) AS BIGINT) AS window_start, count(*) AS n FROM w GROUP BY 1
    """
)
def sliding_budget(spark, d):
    """Events in a sliding hour."""
    counted = library.windowed_counts(table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "at", slide="15 minutes")
    return counted.select(F.unix_seconds("window_start").alias("window_start"), "n")


@query("SELECT conv_id, count(*) AS turns, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS asked, arg_min(text, turn) AS opening, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def conversation_summary(spark, d):
    """Ordered child rows summed up per parent."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.min_by("text", "turn").alias("opening"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT event_id, substr(sha256(user_id || chr(0) || event_type || chr(0) || event_id), 1, 48) AS document_id FROM events")
def document_ids(spark, d):
    """Keys of per-user documents."""
    return table(spark, d, "events").select("event_id", T.document_id("user_id", "event_type", "event_id").alias("document_id"))
