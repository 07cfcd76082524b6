"""User-library state: a log of mutations from many devices, merged by last writer and by per-device counters.

Batch and stream give the same state. The merge is associative and commutative: of an item's mutations the one with the
largest (updated_at, deleted, event_id) wins, and a device's counter is its maximum, so batches may repeat or overlap.
There is no expiry: late mutations are merged, only those dated too far in the future are set aside.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.sources.files import exists, shared_folder

#: How far in the future a mutation's clock may be.
TOLERANCE = "24 hours"
ITEM = ["user_id", "item_id"]


def split_future(mutations: DataFrame, now: Column, tolerance: str = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Valid mutations, and those without a time or beyond now plus the tolerance."""
    ok = F.coalesce(F.col("updated_at") <= now + F.expr(f"INTERVAL {tolerance}"), F.lit(False))
    return mutations.where(ok), mutations.where(~ok)


def latest_state(mutations: DataFrame) -> DataFrame:
    """user_id, item_id, updated_at, deleted, event_id of the last writer. On equal times a deletion wins; of two equal in
    that too the larger event_id, where a store that sees one at a time would keep whichever came first. So the state
    doesn't depend on the order of arrival."""
    last = F.max(F.struct("updated_at", "deleted", "event_id")).alias("s")
    return mutations.groupBy(*ITEM).agg(last).select(*ITEM, "s.updated_at", "s.deleted", "s.event_id")


def device_counts(mutations: DataFrame) -> DataFrame:
    """user_id, item_id, device_id, device_count: each device's largest report."""
    return mutations.groupBy(*ITEM, "device_id").agg(F.max("device_count").alias("device_count"))


def total_counts(devices: DataFrame) -> DataFrame:
    """user_id, item_id, total: the counter over devices."""
    return devices.groupBy(*ITEM).agg(F.sum("device_count").alias("total"))


def merged_state(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State after one more batch; the state has the columns of ``latest_state``."""
    new = latest_state(batch)
    return new if state is None else latest_state(state.unionByName(new))


def recent_items(views: DataFrame, user: str, item: str, at: str, most: int = 80) -> DataFrame:
    """Per user the items viewed last, each once, at most ``most``; adds ``position``."""
    last = views.groupBy(user, item).agg(F.max(at).alias("last_at"))
    rank = F.row_number().over(W.partitionBy(user).orderBy(F.desc("last_at"), item))
    return last.withColumn("position", rank).where(F.col("position") <= most)


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Membership after toggles: in if their number is odd."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("is_member"))


def monotone_clock(events: DataFrame, keys: list[str], order: str, at: str) -> DataFrame:
    """Adds ``logged_at``, in seconds: never earlier than an event before it of the same key, and one more where equal.
    As each is max(own, previous + 1), it is the running maximum of time less rank, plus rank."""
    w = W.partitionBy(*keys).orderBy(order)
    rank = F.row_number().over(w)
    out = events.withColumn("__rank", rank).withColumn("__t", F.unix_seconds(F.col(at).cast("timestamp")) - F.col("__rank"))
    return out.withColumn("logged_at", F.max("__t").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__rank")).drop("__rank", "__t")


def chunks(rows: DataFrame, keys: list[str], order: str, size: int = 500) -> DataFrame:
    """Adds ``chunk``: batches of ``size`` rows per key for sending."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / size).cast("long"))


STATE = "user_id long, item_id string, updated_at timestamp, deleted boolean, event_id long"


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state that a stream's batches have left under its checkpoint; empty before the first."""
    path = f"{checkpoint}/state"
    return latest_state(spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(path)) if exists(spark, f"{path}/*") else spark.createDataFrame([], STATE)


def stream_state(mutations: DataFrame, checkpoint: str, publish: Callable[[DataFrame], None]) -> None:
    """Runs all that is available of a stream of mutations in micro-batches, and ``publish`` gets the state. A batch adds
    its own last writers to the state's folder under the checkpoint, in a place named by its number, so a batch that is
    replayed puts the same rows in the same place; merging happens on reading. A restart goes on from the offsets and the
    state of the same checkpoint, whether or not there is news."""
    spark = mutations.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        latest_state(batch).select("user_id", "item_id", "updated_at", "deleted", "event_id").write.mode("overwrite").parquet(f"{checkpoint}/state/batch-{number:012d}")

    query = mutations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    publish(stored_state(spark, checkpoint))


def windowed_counts(events: DataFrame, at: str, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Rows per (sliding) window of event time; works on streams, where windows close behind the watermark."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def checkpoint_folder(spark: SparkSession) -> str:
    """A new place for a stream's checkpoint."""
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


#: Form of a device's id, longest id of an item, most views that one device may report.
DEVICE, LONGEST_ID, MOST_VIEWS = "(?i)^dev_[a-z0-9_-]{8,76}$", 180, 1_000_000


def checked_mutations(rows: DataFrame, now: Column, tolerance: str = TOLERANCE) -> DataFrame:
    """Adds ``problem``, null for valid mutations: a device's or an item's id of the wrong form, or a time that is missing or
    too far ahead. Ids are trimmed and cut, counts bounded, a deletion is one only if it says so."""
    item = F.substring(F.trim("item_id"), 1, LONGEST_ID)
    bad_item = F.coalesce((item == "") | item.rlike(r"[\x00-\x1f\x7f]"), F.lit(True))
    late = ~F.coalesce(F.col("updated_at") <= now + F.expr(f"INTERVAL {tolerance}"), F.lit(False))
    problem = F.when(~F.coalesce(F.trim("device_id").rlike(DEVICE), F.lit(False)), "device").when(bad_item, "item").when(late, "time")
    count = F.least(F.greatest(F.coalesce("device_count", F.lit(0)), F.lit(0)), F.lit(MOST_VIEWS))
    return rows.withColumn("problem", problem).withColumn("item_id", item).withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("device_count", count)


def compacted(spark: SparkSession, checkpoint: str) -> None:
    """Merges what a stream's batches have left into one table, between two runs. The merged rows are in place before the
    old ones go, and merging them again changes nothing."""
    state = stored_state(spark, checkpoint)
    whole = f"{checkpoint}/state/merged-{uuid.uuid4().hex}"
    state.write.parquet(whole)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(whole).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.listStatus(jvm.Path(f"{checkpoint}/state")):
        if x.getPath().getName() != whole.rsplit("/", 1)[-1]:
            fs.delete(x.getPath(), True)
