"""Achievements granted on a stream: keyed state per user, a ledger of grants, and statistics from the ledger.

A user's state holds the library's items with their last writer, how many are active per metric, and what was granted. It
lies in the state store by item, so that no user's library is in memory, and rows of a user pass by some at a time. A
grant is made once, when a batch leaves a metric at its threshold, and never taken back. With deletions, what is granted
depends on what the batches leave, as each batch is one look at the library; without, any cut into batches and any order
give what one batch gives.

A batch writes its outcomes into the ledger in a place named by its number. A batch that is repeated after a failure finds
the state as it was before and overwrites its own place, so grants and counters are kept exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curatrix.functions.catalogue import ACHIEVEMENTS, DEFAULT_ACHIEVEMENT
from curatrix.sources.files import exists
from curatrix.streaming.state import rocksdb

#: Requests: a library's mutation (metric, item_id, updated_at, deleted, event_id), or a manual grant (achievement_id, reference).
REQUESTS = "user_id long, metric string, item_id string, updated_at timestamp, deleted boolean, event_id long, achievement_id string, reference string"
LEDGER = "user_id long, achievement_id string, outcome string, grant_type string, reference string"
#: The longest reference of a manual grant, and rows of a user that are merged before the store is asked.
REFERENCE, SOME = 240, 4096


class Grants(StatefulProcessor):
    """One user's library and achievements."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "metric string, item_id string", "at long, deleted boolean, event_id long")
        self.active = handle.getMapState("active", "metric string", "n long")
        self.granted = handle.getMapState("granted", "achievement_id string", "grant_type string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out: list[tuple] = []
        # each look at the store is a message to the JVM: a user who is new has nothing there, and counts and grants are read once
        new = fresh = not self.granted.containsKey((DEFAULT_ACHIEVEMENT,))
        self._known = (fresh, {}, {})
        if fresh:
            self._grant(out, key[0], DEFAULT_ACHIEVEMENT, "default", "")
        rows = iter(rows)
        while some := list(islice(rows, SOME)):
            last: dict[tuple, tuple] = {}
            for r in some:
                if r["achievement_id"] is not None:
                    self._manual(out, key[0], r["achievement_id"], r["reference"])
                elif None not in (r["metric"], r["item_id"], r["at"]):
                    place, put = (r["metric"], r["item_id"]), (r["at"], bool(r["deleted"]), r["event_id"] or 0)
                    if put > last.get(place, (put[0] - 1,)):
                        last[place] = put
            self._library(last, new)
            new = new and not last
        for metric, n in self._known[1].items():
            self.active.updateValue((metric,), (n,))
        for name, (_, kind, metric, least, _) in ACHIEVEMENTS.items():
            if kind == "automatic" and self._count(metric) >= least and not self._has(name):
                self._grant(out, key[0], name, kind, f"metric:{metric}")
        yield from (Row(user_id=u, achievement_id=a, outcome=o, grant_type=g, reference=r) for u, a, o, g, r in out)

    def _count(self, metric: str) -> int:
        fresh, counts, _ = self._known
        if metric not in counts and not fresh:
            counts[metric] = (self.active.getValue((metric,)) or (0,))[0]
        return counts.get(metric, 0)

    def _has(self, name: str) -> bool:
        fresh, _, held = self._known
        if name not in held:
            held[name] = not fresh and self.granted.containsKey((name,))
        return held[name]

    def _library(self, last: dict[tuple, tuple], new: bool) -> None:
        """Merges last writers, and counts items that became active or ceased to be. A new user's items aren't looked for."""
        moved: dict[str, int] = {}
        for place, put in last.items():
            old = None if new else self.items.getValue(place)
            if old is None or put > tuple(old):
                self.items.updateValue(place, put)
                moved[place[0]] = moved.get(place[0], 0) + (not put[1]) - (old is not None and not old[1])
        for metric, n in moved.items():
            self._known[1][metric] = self._count(metric) + n

    def _manual(self, out: list[tuple], user: int, name: str, reference: str | None) -> None:
        name, reference = name.strip(), (reference if isinstance(reference, str) else "").strip()[:REFERENCE]
        if name not in ACHIEVEMENTS or ACHIEVEMENTS[name][1] != "manual":
            out.append((user, name, "manual_only", "manual", reference))
        elif not reference:
            out.append((user, name, "reference_required", "manual", reference))
        elif not self._has(name):
            self._grant(out, user, name, "manual", reference)

    def _grant(self, out: list[tuple], user: int, name: str, kind: str, reference: str) -> None:
        self.granted.updateValue((name,), (kind,))
        self._known[2][name] = True
        out.append((user, name, "granted", kind, reference))

    def close(self) -> None:
        pass


def ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All outcomes so far: grants, and manual requests that were refused."""
    path = f"{checkpoint}/ledger"
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(path) if exists(spark, f"{path}/*") else spark.createDataFrame([], LEDGER)


def granted(spark: SparkSession, checkpoint: str) -> DataFrame:
    return ledger(spark, checkpoint).where("outcome = 'granted'").drop("outcome")


def statistics(grants: DataFrame) -> DataFrame:
    """achievement_id, unlocked, active_users: counters over the ledger, for achievements that nobody has too."""
    names = grants.sparkSession.createDataFrame([(n,) for n in ACHIEVEMENTS], "achievement_id string")
    counts = grants.groupBy("achievement_id").agg(F.count("*").alias("unlocked"))
    active = counts.where(F.col("achievement_id") == DEFAULT_ACHIEVEMENT).select(F.col("unlocked").alias("active_users"))
    rows = names.join(counts, "achievement_id", "left").select("achievement_id", F.coalesce("unlocked", F.lit(0)).alias("unlocked"))
    return rows.join(active, how="left").withColumn("active_users", F.coalesce("active_users", F.lit(0)))  # one row at most


def run(requests: DataFrame, accounts: DataFrame, checkpoint: str) -> None:
    """Works off all that is available of a stream of requests. Requests of users whose account is deleted or being deleted,
    or that have none, have no outcome; ``accounts`` has user_id and account_status (null: active)."""
    spark = requests.sparkSession
    alive = accounts.where(~F.coalesce(F.nullif(F.trim("account_status"), F.lit("")), F.lit("active")).isin("deleted", "deleting")).select("user_id")
    rows = requests.withColumn("at", F.unix_micros("updated_at")).drop("updated_at")
    # rows, not frames: a user has few of them, and making frames takes longer than all else
    outcomes = rows.join(alive, "user_id").groupBy("user_id").transformWithState(Grants(), LEDGER, "append", "none")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}/ledger/batch-{number:012d}")

    with rocksdb(spark):
        query = outcomes.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
