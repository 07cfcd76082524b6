"""Readers and writers of record files, and keyed table changes as rewrites.

A keyed change (upsert, delete, replacement) reads the current rows and gives the new ones; the caller writes them to a
new place, as tables of plain files can't be changed under a reader.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_records(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """JSON Lines, or one JSON array per file. Bad records fail the read."""
    return spark.read.schema(schema).json(path, multiLine=array, mode="FAILFAST")


def json_records_with_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with ``bad_record`` holding the text of lines that don't parse."""
    return spark.read.schema(schema + ", bad_record STRING").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_record")


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header: quoted fields, doubled quotes, line breaks in fields; rows without any value are dropped and
    a byte-order mark in front of the first value goes."""
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=True, encoding="UTF-8")
    first = rows.columns[0]
    return rows.withColumn(first, F.regexp_replace(first, r"^\x{FEFF}", "")).where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in rows.columns]).isNotNull())


def flattened(df: DataFrame) -> DataFrame:
    """For CSV: arrays of texts joined by a bar, other nested values as JSON."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(F.concat_ws("|", f"`{f.name}`").alias(f.name) if kind == "array<string>" else F.to_json(f"`{f.name}`").alias(f.name) if kind.startswith(("array", "struct", "map")) else F.col(f"`{f.name}`").cast("string").alias(f.name))
    return df.select(*out)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, windows: bool = False) -> None:
    """CSV with a header, quotes where needed. For spreadsheet programs (``windows``) each file begins with a byte-order mark
    and its lines end with carriage return and line feed, those inside fields too; read back, these are line feeds."""
    rows = flattened(df)
    if windows:
        first = rows.columns[0]
        rows = rows.select([F.regexp_replace(f"`{c}`", "\r\n", "\n").alias(c) for c in rows.columns]).withColumnRenamed(first, f"\ufeff{first}")
    rows.write.csv(path, header=True, escape='"', lineSep="\r\n" if windows else "\n", emptyValue="")


def object_listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Path and size of stored objects whose name matches; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where(F.element_at(F.split("path", "/"), -1).rlike(pattern))


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows with those of ``changes`` put in place or added; ``changes`` has one row per key."""
    return current.join(changes, keys, "left_anti").unionByName(changes)


def inserted_if_absent(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows and those of ``rows`` whose key is new; of repeated new keys the smallest row is taken."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*") if rest else rows.distinct()
    return current.unionByName(first.join(current, keys, "left_anti"))


def without(current: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(doomed, keys, "left_anti")


def merged(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Right-biased merge of rows by key: a value of ``changes`` that isn't null wins; rows of either side stay."""
    rest = [c for c in current.columns if c not in keys]
    joined = current.alias("a").join(changes.alias("b"), keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in changes.columns else F.col(f"a.{c}") for c in rest])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, empty or seen more than once, with their count."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("n")).where("n > 1 OR key = ''")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session (tests) may go without one and gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="curatrix-")
    return folder


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes the path when the session's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def staged(df: DataFrame) -> DataFrame:
    """The rows written once to the session's shared folder and read again; cuts the lineage of iterative jobs. The files
    go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: The most rows of a join's smaller side that are sent out to all tasks.
FEW_ROWS = 100_000


def sent_or_merged(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """The smaller side of a join, written once and counted: sent out to all tasks if there are few rows (at most ``most``, which
    may be more of narrow ones), else to be met by a sorted merge. For sides that are exploded or grouped, which Spark takes for as large as what they are read from."""
    rows = staged(df)
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a pattern of paths has anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop package, a path, and its file system."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    return fs, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> str | None:
    """The text of a pointer file; None before there is one."""
    _, place, system = _hadoop(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def point(spark: SparkSession, path: str, text: str) -> None:
    """Puts a pointer file in place by one rename over the old one: a reader finds the old text or the new one."""
    fs, place, system = _hadoop(spark, path)
    fresh = fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = system.create(fresh)
    stream.write(text.encode())
    stream.close()
    kind = fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, place, over)


#: The pointer of a published table, beside the folders of its versions.
CURRENT = "_current"


def published_path(spark: SparkSession, path: str) -> str | None:
    """Where the files of a published table are now; None before the first."""
    version = pointer(spark, f"{path}/{CURRENT}")
    return version and f"{path}/{version}"


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there: then no rows. A published one is read where its pointer says."""
    place = published_path(spark, path) or path
    return spark.read.schema(schema).parquet(place) if exists(spark, place) else spark.createDataFrame([], schema)


def published(df: DataFrame, path: str) -> None:
    """Writes a new version beside the old ones and then puts it in place by its pointer, in one rename: at any time, and if
    the writer dies at any point, readers find the old files or all of the new. The version before stays for readers that
    have begun; older ones, and what broken writers have left, go."""
    spark = df.sparkSession
    before = pointer(spark, f"{path}/{CURRENT}")
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    point(spark, f"{path}/{CURRENT}", version)
    _, place, system = _hadoop(spark, path)
    for x in system.listStatus(place):
        if x.getPath().getName() not in (version, before, CURRENT, f".{CURRENT}.crc"):
            system.delete(x.getPath(), True)
