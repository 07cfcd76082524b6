"""Grants on a stream: batches, order, repetition, deletions and a failure in between."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from curatrix.functions.catalogue import ACHIEVEMENTS
from curatrix.streaming import grants

MONDAY = 1_700_000_000


def request(user, metric=None, item=None, at=0, deleted=False, event=0, name=None, reference=None):
    return (user, metric, item, MONDAY + at, deleted, event, name, reference)


class Inbox:
    """A folder that a stream reads file by file."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.checkpoint, self.n = spark, f"{tmp_path}/in", f"{tmp_path}/check", itertools.count()

    def add(self, rows):
        df = self.spark.createDataFrame(rows, grants.REQUESTS.replace("updated_at timestamp", "at long")).withColumn("updated_at", F.timestamp_seconds("at"))
        df.select("user_id", "metric", "item_id", "updated_at", "deleted", "event_id", "achievement_id", "reference").coalesce(1).write.parquet(f"{self.path}/{next(self.n):04d}")

    def run(self, statuses=()):
        stream = self.spark.readStream.schema(grants.REQUESTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(self.path)
        users = self.spark.range(1, 10).select(F.col("id").alias("user_id")).join(self.spark.createDataFrame(list(statuses) or [(0, "active")], "user_id long, account_status string"), "user_id", "left")
        grants.run(stream, users, self.checkpoint)
        return sorted(tuple(r) for r in grants.ledger(self.spark, self.checkpoint).collect())


def want_of(rows):
    """What one look at all rows gives."""
    out = set()
    for user in {r[0] for r in rows}:
        out.add((user, "ordinary_user", "granted", "default", ""))
        items = {}
        for _, metric, item, at, deleted, event, name, reference in (r for r in rows if r[0] == user):
            if name:
                if name == "learned_all_ages" and reference:
                    out.add((user, name, "granted", "manual", reference))
            else:
                items[metric, item] = max(items.get((metric, item), ()), (at, deleted, event))
        for name, (_, kind, metric, least, _) in ACHIEVEMENTS.items():
            if kind == "automatic" and sum(m == metric and not v[1] for (m, _), v in items.items()) >= least:
                out.add((user, name, "granted", "automatic", f"metric:{metric}"))
    return sorted(out)


def test_any_batches_and_order_give_one_result(spark, tmp_path):
    rng = random.Random(1)
    rows = [request(u, m, f"i{k}", k, False, k) for u in (1, 2, 3) for m, n in (("favorite_unique_count", 7 * u), ("followed_artist_unique_count", 5 * u), ("history_unique_count", 20 * u)) for k in range(n)]
    rows += [request(2, name="learned_all_ages", reference="case 7")]
    results = []
    for k in range(2):
        mixed = rows * (1 + k)  # the second time everything comes twice
        rng.shuffle(mixed)
        inbox = Inbox(spark, tmp_path / str(k))
        for part in (mixed[:40], mixed[40:90], mixed[90:]):
            inbox.add(part)
        results.append(inbox.run())
        assert inbox.run() == results[-1]  # a restart without news changes nothing
    assert results == [want_of(rows)] * 2


def test_deletions_and_refusals(spark, tmp_path):
    inbox = Inbox(spark, tmp_path)
    inbox.add([request(1, "favorite_unique_count", "a", 5, False, 1), request(1, "favorite_unique_count", "a", 9, True, 2), request(2, name="learned_all_ages"), request(2, name="first_masterpiece", reference="x"), request(2, name="none", reference="x"), request(4, "favorite_unique_count", None, 1), request(5, "favorite_unique_count", "a"), request(99, "favorite_unique_count", "a")])
    first = inbox.run([(5, "deleting")])
    assert first == [(1, "ordinary_user", "granted", "default", ""), (2, "first_masterpiece", "manual_only", "manual", "x"), (2, "learned_all_ages", "reference_required", "manual", ""), (2, "none", "manual_only", "manual", "x"), (2, "ordinary_user", "granted", "default", ""), (4, "ordinary_user", "granted", "default", "")]
    inbox.add([request(1, "favorite_unique_count", "a", 7, False, 3)])  # older than the deletion
    assert inbox.run() == first
    inbox.add([request(1, "favorite_unique_count", "a", 10, False, 4)])
    assert inbox.run() == sorted([*first, (1, "first_masterpiece", "granted", "automatic", "metric:favorite_unique_count")])
    inbox.add([request(1, "favorite_unique_count", "a", 11, True, 5), request(1, "favorite_unique_count", "b", 12, False, 6)])
    assert len(inbox.run()) == len(first) + 1  # kept, and not granted again


def test_a_batch_that_fails_after_its_sink_is_repeated(spark, tmp_path, monkeypatch):
    inbox = Inbox(spark, tmp_path)
    rows = [request(u, "favorite_unique_count", f"i{k}", k, False, k) for u in (1, 2) for k in range(25)]
    inbox.add(rows[:30])
    inbox.add(rows[30:])
    broken = []

    from pyspark.sql.readwriter import DataFrameWriter

    plain = DataFrameWriter.parquet

    def once(self, path, *a, **b):
        plain(self, path, *a, **b)
        if path.endswith("batch-000000000001") and not broken:
            broken.append(path)
            raise OSError("lost")

    monkeypatch.setattr(DataFrameWriter, "parquet", once)
    with pytest.raises(Exception, match="lost|STREAM"):
        inbox.run()
    assert broken
    assert inbox.run() == want_of(rows)
    counts = {r.achievement_id: (r.unlocked, r.active_users) for r in grants.statistics(grants.granted(spark, inbox.checkpoint)).collect()}
    assert counts == {n: ({"ordinary_user": 2, "first_masterpiece": 2, "treasure_with_care": 2}.get(n, 0), 2) for n in ACHIEVEMENTS}


class Store(dict):
    """A map state that counts the messages it takes."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value


def test_a_new_users_items_are_written_and_not_looked_for(monkeypatch):
    monkeypatch.setattr(grants, "SOME", 50)
    names = ["metric", "item_id", "at", "deleted", "event_id", "achievement_id", "reference"]
    rows = [dict(zip(names, ("favorite_unique_count", str(i % 40), i, False, i, None, None), strict=True)) for i in range(50)]
    user = grants.Grants()
    user.items, user.active, user.granted = Store(), Store(), Store()
    first = list(user.handleInputRows((1,), iter(rows), None))
    assert user.items.asked == 40 and user.active == {("favorite_unique_count",): (40,)} and user.items[("favorite_unique_count", "9")] == (49, False, 49)
    assert user.active.asked == 1 and user.granted.asked <= 1 + len(first)
    gone = [dict(zip(names, ("favorite_unique_count", str(i), 99, True, i, None, None), strict=True)) for i in range(10)]
    assert list(user.handleInputRows((1,), iter(gone), None)) == [] and user.items.asked == 60 and user.active[("favorite_unique_count",)] == (30,)
