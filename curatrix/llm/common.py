"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read with Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and whole ``text`` (null: empty); other columns are dropped, so no name of theirs can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column without nulls; bytes that are not UTF-8 become replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of a task by a few at a time, so that only few texts are Python objects at once and results leave in small
    batches. Workers outlive their tasks: what Arrow's pool still holds unused then goes back to the system."""
    try:
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)
    finally:
        pa.default_memory_pool().release_unused()


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(n)


def characters(text: str) -> Iterator[tuple[str, int]]:
    """Each distinct character with its count."""
    if text.isascii():
        n = np.bincount(np.frombuffer(text.encode(), np.uint8))
        at = np.flatnonzero(n)
        return zip(map(chr, at.tolist()), n[at].tolist(), strict=True)
    at, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    return zip(map(chr, at.tolist()), n.tolist(), strict=True)


def _first_by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's first row of each doc_id."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i in batch.column("doc_id").to_pylist():
            new.append(i not in seen)
            seen.add(i)
        yield batch.filter(pa.array(new, pa.bool_()))


def one_each(plain: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text and label of the ids in ``chosen`` (few, each once): of rows with the same id the one whose text
    has the smallest hash. Equal rows of an id leave a task once, so an id with very many rows moves no more."""
    joined = plain.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    least = joined.groupBy("doc_id").agg(F.min("h").alias("h"))
    kept = joined.join(F.broadcast(least), ["doc_id", "h"]).select("doc_id", "text", "label")
    return kept.mapInArrow(_first_by_id, kept.schema).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("label").alias("label"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session (tests) may go without one and gets a temporary folder: the
    executors of a cluster couldn't read what the others wrote there."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context.getCheckpointDir().isDefined():
        folder = context.getCheckpointDir().get()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="curatrix-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, short lineage, safe when executors are lost. The table
    goes when the session's JVM ends, or with ``drop_tables``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _tables.append(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = folder
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that ``written`` has given, once nothing reads it any more."""
    folder = df.written_at
    folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _tables.remove(folder)


#: Tables of this process that still lie in the shared folder.
_tables: list = []


def drop_tables(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` has left so far and gives their number. For between jobs of a long session,
    once the results that read them are stored."""
    n = len(_tables)
    while _tables:
        folder = _tables.pop()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def one_of_each(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in its own columns, that ``gone`` doesn't name by id or by id and hash of the text; of rows
    repeated in all columns one. Only rows whose id occurs again can be repeated, so all others stay where they are, as far
    as the optimiser sends out the ids. Columns travel in a struct, so none can clash."""
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), raw.alias("raw"))
    kept = rows.join(gone, [c for c in ("doc_id", "raw") if c in gone.columns], "left_anti")
    again = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return kept.select("row.*")
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return kept.join(again, same, "left_anti").select("row").unionByName(kept.join(again, same, "left_semi").select("row").dropDuplicates()).select("row.*")


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
