"""Ingest as a stream: growing folders, quotas, failures and history."""

import itertools

from pyspark.sql import functions as F

from curatrix.streaming import ingest

ROW = "n long, url string, title string"


class Crawl:
    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.checkpoint, self.n = spark, f"{tmp_path}/in", f"{tmp_path}/check", itertools.count()

    def add(self, *rows):
        self.spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{self.path}/{next(self.n):04d}")

    def run(self, files=None, batches=None):
        source = self.spark.readStream.schema(ROW).option("recursiveFileLookup", "true")
        rows = (source.option("maxFilesPerTrigger", files) if files else source).parquet(self.path)
        found = ingest.outcomes(rows, F.lower("url"), F.col("n"), F.when(F.coalesce("title", F.lit("")) == "", "no title"))
        schema = ingest.run(self.spark, found, self.checkpoint, batches)
        return sorted((r.n, r.outcome, r.failures) for r in ingest.results(self.spark, self.checkpoint, schema).collect())

    def of(self, outcome):
        schema = ingest.outcomes(self.spark.readStream.schema(ROW).parquet(self.path), F.lower("url"), F.col("n"), F.lit(None).cast("string")).schema
        return sorted(r.n for r in ingest.results(self.spark, self.checkpoint, schema, outcome).collect())


FILES = [
    [(1, "a", "A"), (2, "A", "A again"), (3, "b", None)],
    [(4, "b", "B"), (5, "c", ""), (6, None, "lost")],
    [(7, "a", "A"), (8, "c", "C"), (9, "c", "C"), (10, "b", None)],
]


def test_runs_over_a_growing_folder_equal_one_run(spark, tmp_path):
    one, many = Crawl(spark, tmp_path / "one"), Crawl(spark, tmp_path / "many")
    for rows in FILES:
        many.add(*rows)
        many.run()
        one.add(*rows)
    one.run()
    assert one.of("accepted") == many.of("accepted") == [1, 4, 8]
    got = many.run()
    assert got == [(1, "accepted", 0), (2, "skipped", 0), (3, "failed", 1), (4, "accepted", 1), (5, "failed", 1), (6, "failed", 1), (7, "skipped", 0), (8, "accepted", 1), (9, "skipped", 1), (10, "skipped", 1)]
    assert sorted(one.of("accepted") + one.of("skipped") + one.of("failed")) == list(range(1, 11))


def test_a_quota_stops_a_run_and_the_next_goes_on(spark, tmp_path):
    crawl = Crawl(spark, tmp_path)
    for rows in FILES:
        crawl.add(*rows)
    first = crawl.run(files=1, batches=1)
    assert [n for n, *_ in first] == [1, 2, 3]
    assert [n for n, *_ in crawl.run(files=1, batches=1)] == [1, 2, 3, 4, 5, 6]
    assert crawl.of("accepted") == [1, 4]
    assert len(crawl.run(files=1)) == 10
    assert len(crawl.run(files=1, batches=2)) == 10
    assert crawl.of("accepted") == [1, 4, 8]


def test_a_key_with_very_many_rows(spark, tmp_path):
    crawl = Crawl(spark, tmp_path)
    spark.range(30_000).select(F.col("id").alias("n"), F.lit("x").alias("url"), F.when(F.col("id") % 3 != 0, "t").alias("title")).coalesce(1).write.parquet(f"{crawl.path}/0")
    crawl.run()
    assert crawl.of("accepted") == [1]
    assert (len(crawl.of("skipped")), len(crawl.of("failed"))) == (19_999, 10_000)
