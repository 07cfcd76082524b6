"""Whether an image is the same wherever it is kept: in the store, in a folder, and at the source that its work names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """id (the file's name without its ending), bytes, hash of the files whose name matches; each task reads its own files. Spark
    reads no empty files, so an empty one counts as missing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(name.alias("id"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))


def matched_images(images: DataFrame, works: DataFrame, stored: DataFrame, local: DataFrame, expected: DataFrame) -> DataFrame:
    """id, work_id, source_url, storage_bytes, local_bytes, expected_bytes, and three answers, per row of ``images`` (id, work_id).

    ``works`` (id, source_url) names the source of a work; ``stored``, ``local`` (id) and ``expected`` (source_url) have bytes
    and hash. A missing side matches nothing. Only hashes move in the joins; repeated files of one id take the smallest
    hash."""
    one = lambda df, key, name: df.groupBy(F.col(key).alias(f"__{name}")).agg(F.min(F.struct("hash", "bytes")).alias(name))
    urls = works.groupBy(F.col("id").alias("work_id")).agg(F.min("source_url").alias("source_url"))
    rows = images.select("id", "work_id").join(urls, "work_id", "left")
    for df, key, by, name in ((stored, "id", "id", "storage"), (local, "id", "id", "local"), (expected, "source_url", "source_url", "expected")):
        rows = rows.join(one(df, key, name), F.col(by) == F.col(f"__{name}"), "left")
    same = lambda a, b: F.coalesce(F.col(f"{a}.hash") == F.col(f"{b}.hash"), F.lit(False))
    return rows.select(
        "id",
        "work_id",
        "source_url",
        *[F.col(f"{n}.bytes").alias(f"{n}_bytes") for n in ("storage", "local", "expected")],
        same("storage", "local").alias("storage_matches_local"),
        same("storage", "expected").alias("storage_matches_expected"),
        same("local", "expected").alias("local_matches_expected"),
    )


def match_summary(matched: DataFrame) -> DataFrame:
    """One row: how many images, how many of each answer, and how many sides are missing."""
    answers = ["storage_matches_local", "storage_matches_expected", "local_matches_expected"]
    missing = [F.count_if(F.col(f"{n}_bytes").isNull()).alias(f"{n}_missing") for n in ("storage", "local", "expected")]
    return matched.agg(F.count("*").alias("images"), *[F.count_if(a).alias(a) for a in answers], *missing)
