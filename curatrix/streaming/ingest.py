"""Ingest of crawled files as a stream with history: what was taken once is not taken again.

New files of a folder are read in the order they came. Each key (a work's address) has its history in the state store:
whether it was taken, and how often it failed. A key's first valid row is accepted, valid ones behind it and whatever comes
in later batches are skipped; invalid rows fail with their reason, which doesn't keep a later valid row from being taken.
Each outcome goes into a folder of its own, in a place named by the batch's number, so a repeated batch overwrites itself.
A run works off everything, or stops after a number of batches of so many files: its quota.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from curatrix.sources.files import exists
from curatrix.streaming.state import rocksdb

ACCEPTED, SKIPPED, FAILED = "accepted", "skipped", "failed"


class History(StatefulProcessor):
    """One key's rows: outcome, and number of failures so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "accepted boolean, failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        accepted, failures = self.seen.get() if self.seen.exists() else (False, 0)
        before, best = accepted, None
        for frame in rows:
            if before:
                yield frame.assign(outcome=SKIPPED, failures=failures)
                continue
            bad = frame[frame["reason"].notna()].sort_values("position")
            if len(bad):
                yield bad.assign(outcome=FAILED, failures=range(failures + 1, failures + len(bad) + 1))
                failures += len(bad)
            good = frame[frame["reason"].isna()]
            if len(good):
                good = good if best is None else pd.concat([best, good])
                good = good.sort_values("position", kind="stable")
                best, rest = good.iloc[:1], good.iloc[1:]
                if len(rest):
                    yield rest.assign(outcome=SKIPPED, failures=failures)
        if best is not None:
            accepted = True
            yield best.assign(outcome=ACCEPTED, failures=failures)
        if not before:
            self.seen.update((accepted, failures))

    def close(self) -> None:
        pass


def outcomes(rows: DataFrame, key: Column, position: Column, reason: Column) -> DataFrame:
    """A stream's rows with key, position, reason (null: valid), outcome and failures. Of a batch's valid rows of a key the
    one with the smallest position is accepted. Rows without a key fail with that reason."""
    named = F.coalesce(key, F.lit(""))
    put = rows.withColumn("key", named).withColumn("position", position).withColumn("reason", F.when(named == "", "no key").otherwise(reason))
    schema = StructType([*put.schema.fields, StructField("outcome", StringType()), StructField("failures", LongType())])
    return put.groupBy("key").transformWithStateInPandas(History(), schema, "append", "none")


def results(spark: SparkSession, checkpoint: str, schema: StructType, outcome: str | None = None) -> DataFrame:
    """What all runs so far have written: rows of one outcome, or all."""
    path = f"{checkpoint}/out"
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*") if exists(spark, f"{path}/batch=*") else spark.createDataFrame([], schema)
    return rows.select(*schema.names).where(F.col("outcome") == outcome) if outcome else rows.select(*schema.names)


def run(spark: SparkSession, found: DataFrame, checkpoint: str, batches: int | None = None, patience: float = 600.0) -> StructType:
    """Works off a stream that ``outcomes`` gave: all that is available, or ``batches`` micro-batches and no more (fewer if
    there aren't as many); how many files one takes is the source's ``maxFilesPerTrigger``. Gives the rows' schema."""
    schema = found.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{checkpoint}/out/batch={number:012d}")

    with rocksdb(spark):
        writer = found.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint)
        if batches is None:
            writer.trigger(availableNow=True).start().awaitTermination()
            return schema
        for _ in range(batches):
            # the first batch begins at once, the next one would a day later
            query = writer.trigger(processingTime="1 day").start()
            end = time.monotonic() + patience
            while query.isActive and not query.recentProgress and time.monotonic() < end:
                time.sleep(0.05)
            told = query.recentProgress
            query.stop()
            if query.exception():
                raise query.exception()
            if not told or told[-1].numInputRows == 0:
                break
    return schema
