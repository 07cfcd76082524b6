"""State of long runs, kept so that a run that broke off goes on where it stopped: what was made, what was seen, and the
next number. A step writes all of them under a number of its own, and one pointer file that names it is put in place last
(``files.point``), so the three always belong together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.sources.files import _hadoop, optional_table, point, pointer

SEEN = "key string"
MARK = "mark"


def resumed(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows made, keys seen, and the next number of a run that is still marked as running; else a new run's."""
    mark = json.loads(pointer(spark, f"{path}/{MARK}") or "{}")
    if mark.get("status") != "running":
        return spark.createDataFrame([], schema), spark.createDataFrame([], SEEN), 1
    step = f"{path}/{mark['step']}"
    return optional_table(spark, f"{step}/rows", schema), optional_table(spark, f"{step}/seen", SEEN), mark["next_number"]


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key the run hasn't dealt with."""
    return rows.join(seen.select(F.col("key").alias(key)), key, "left_anti")


def saved(path: str, rows: DataFrame, seen: DataFrame, next_number: int, status: str = "running") -> None:
    """Puts the run's state in place. A run that breaks off before the mark repeats the step from the state before."""
    spark, step = rows.sparkSession, f"step-{uuid.uuid4().hex}"
    before = json.loads(pointer(spark, f"{path}/{MARK}") or "{}").get("step")
    rows.write.parquet(f"{path}/{step}/rows")
    seen.select("key").distinct().write.parquet(f"{path}/{step}/seen")
    point(spark, f"{path}/{MARK}", json.dumps({"status": status, "next_number": next_number, "step": step}))
    _, place, system = _hadoop(spark, path)
    for x in system.listStatus(place):
        if x.getPath().getName().startswith("step-") and x.getPath().getName() not in (step, before):
            system.delete(x.getPath(), True)


def advanced(spark: SparkSession, path: str, rows: DataFrame, key: str, schema: str, number: str, *order: str) -> DataFrame:
    """One step of a run: unseen rows are numbered in order from the next number, added to what was made, and saved. A key's
    rows within a step are taken for one: the first in order."""
    from curatrix.operators.select import numbered

    made, seen, first = resumed(spark, path, schema)
    once = unseen(rows, seen, key).groupBy(key).agg(F.min(F.struct(*order, *[c for c in rows.columns if c != key and c not in order])).alias("__row")).select(key, "__row.*")
    fresh = numbered(once, *order, start=first).withColumnRenamed("number", number)
    every = made.unionByName(fresh.select(made.columns))
    saved(path, every, seen.unionByName(fresh.select(F.col(key).cast("string").alias("key"))), first + fresh.count())
    return resumed(spark, path, schema)[0]
