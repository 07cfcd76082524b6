"""A store that gives its rows page by page, as a Spark data source.

Pages are numbered from 0. A batch read deals ranges of pages to tasks; a stream's offset is the next page, so a stream that
broke off at a page goes on with that page and reads none before it again. A page that can't be had is asked for again,
after waits that double; then the task fails, and Spark tries it elsewhere. A store that gives the same page under two
numbers, or an id on two pages, has shifted under its reader: ``repeats`` reports both.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Tries per page, first and longest wait in seconds, share of it that is drawn at random.
TRIES, WAIT, LONGEST, JITTER = 4, 0.5, 8.0, 0.25


class Store(Protocol):
    def pages(self) -> int:
        """How many pages there are now."""

    def page(self, number: int) -> list[dict]:
        """A page's rows in order."""


class Folder:
    """JSON Lines under ``page=<number>`` folders, on any file system that pyarrow opens."""

    def __init__(self, path: str):
        self.path = path

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def pages(self) -> int:
        from pyarrow import fs

        system, path = self._system()
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return 0
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(path)) if x.base_name.startswith("page=")]
        return max((int(n.split("=")[1]) + 1 for n in names), default=0)

    def page(self, number: int) -> list[dict]:
        from pyarrow import fs

        system, path = self._system()
        files = sorted(x.path for x in system.get_file_info(fs.FileSelector(f"{path}/page={number}")) if x.base_name.endswith(".json"))
        rows = []
        for f in files:
            with system.open_input_stream(f) as s:
                rows += [json.loads(line) for line in s.read().decode().splitlines() if line]
        return rows


def fetched(store: Store, number: int, tries: int = TRIES, wait: float = WAIT) -> list[dict]:
    for k in range(tries):
        try:
            return store.page(number)
        except OSError:
            if k + 1 == tries:
                raise
            pause = min(wait * 2**k, LONGEST)
            time.sleep(pause * (1 + JITTER * (2 * random.random() - 1)))
    raise AssertionError


class Range(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


def _ranges(first: int, end: int, parts: int) -> list[Range]:
    step = max(1, -(-(end - first) // max(parts, 1)))
    return [Range(k, min(k + step, end)) for k in range(first, end, step)]


class _Pages:
    """What both readers share."""

    def __init__(self, store: Store, schema: StructType, options: dict):
        self.store, self.fields = store, [f.name for f in schema.fields[2:]]
        self.parts, self.wait = int(options.get("parts", 8)), float(options.get("wait", WAIT))
        self.first, self.most = int(options.get("first", 0)), int(options.get("pagespertrigger", 0))

    def read(self, partition: Range) -> Iterator[tuple]:
        for number in range(partition.first, partition.end):
            for place, row in enumerate(fetched(self.store, number, wait=self.wait)):
                yield (number, place, *(row.get(f) for f in self.fields))


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        return _ranges(self.first, self.store.pages(), self.parts) or [Range(0, 0)]


class PageStream(_Pages, DataSourceStreamReader):
    """At most ``pagesPerTrigger`` pages a batch, where that is set."""

    def initialOffset(self) -> dict:
        return {"page": self.first}

    def latestOffset(self) -> dict:
        end, begun = self.store.pages(), getattr(self, "begun", None)
        if self.most and begun is not None:
            end = min(end, begun + self.most)
        self.begun = end
        return {"page": end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start["page"], end["page"], self.parts) or [Range(0, 0)]

    def commit(self, end: dict) -> None:
        self.begun = end["page"]


def paged(name: str, store: Store, fields: str) -> type[DataSource]:
    """A data source to be registered with ``spark.dataSource.register``; its rows have page, place on it, and ``fields``,
    primitive columns by a DDL schema. Options: ``first`` page, ``parts`` (tasks), ``wait`` before a second try."""
    whole = f"page int, place int, {fields}"

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return whole

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(store, schema, self.options)

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return PageStream(store, schema, self.options)

    return Source


def repeats(rows: DataFrame, key: str) -> DataFrame:
    """kind, page, of, key: pages that hold what an earlier page holds (kind page), and ids on more than one page or twice on
    one (kind id, ``page`` the later place). A page is known by its number of rows and two sums of its ids' hashes, so no
    page is put together in one place."""
    sums = rows.groupBy("page").agg(F.count("*").alias("n"), *[F.sum(F.xxhash64(F.col(key).cast("string"), F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)])
    first = sums.groupBy("n", "h0", "h1").agg(F.min("page").alias("of"))
    pages = sums.join(first, ["n", "h0", "h1"]).where(F.col("page") > F.col("of")).select(F.lit("page").alias("kind"), "page", "of", F.lit(None).cast("string").alias("key"))
    ids = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.min("page").alias("of"), F.max("page").alias("page"), F.count("*").alias("n")).where("n > 1")
    return pages.unionByName(ids.select(F.lit("id").alias("kind"), "page", "of", "key"))


def sound(rows: DataFrame, key: str) -> DataFrame:
    """Each id's row from its first place, without the pages that repeat an earlier one."""
    again = repeats(rows, key).where("kind = 'page'").select("page")
    kept = rows.join(again, "page", "left_anti")
    rest = [c for c in rows.columns if c not in (key, "page", "place")]
    return kept.groupBy(key).agg(F.min(F.struct("page", "place", *rest)).alias("r")).select("r.page", "r.place", key, *[f"r.{c}" for c in rest])
