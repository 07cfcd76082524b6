"""Files that must survive a writer's death: pointers, published tables, long runs; releases and spreadsheet CSV."""

import pytest
from pyspark.sql import functions as F

from curatrix.operators import release
from curatrix.sources import files, runs


class Died(Exception):
    pass


def dying(monkeypatch, module, name, after):
    """The function works ``after`` times and then breaks off before it does anything."""
    plain, left = getattr(module, name), [after]

    def call(*a, **b):
        if not left[0]:
            raise Died
        left[0] -= 1
        return plain(*a, **b)

    monkeypatch.setattr(module, name, call)


def test_a_reader_finds_the_old_or_the_new_table_whenever_the_writer_dies(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    now = lambda: files.optional_table(spark, path, "id long").count()
    assert now() == 0
    with monkeypatch.context() as m, pytest.raises(Died):
        dying(m, files, "point", 0)
        files.published(spark.range(3), path)
    assert now() == 0
    files.published(spark.range(3), path)
    reader = files.optional_table(spark, path, "id long")
    with monkeypatch.context() as m, pytest.raises(Died):
        dying(m, files, "point", 0)
        files.published(spark.range(5), path)
    assert now() == 3
    files.published(spark.range(7), path)
    assert now() == 7 and reader.count() == 3  # who began before still reads
    files.published(spark.range(9), path)
    assert now() == 9 and len([x for x in (tmp_path / "t").iterdir() if x.is_dir()]) == 2


def test_pointers_are_replaced_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/p"
    assert files.pointer(spark, path) is None
    for text in ("one", "zwei é", ""):
        files.point(spark, path, text)
        assert files.pointer(spark, path) == text
    assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["p"]


@pytest.mark.parametrize("alive", [0, 1])
def test_a_run_that_breaks_off_repeats_no_row(spark, tmp_path, monkeypatch, alive):
    path, schema = f"{tmp_path}/run", "key string, number long"
    rows = spark.range(10).select(F.col("id").cast("string").alias("key"), "id")
    step = lambda df: runs.advanced(spark, path, df, "key", schema, "number", "id")
    if alive:
        step(rows.where("id < 5"))
    with monkeypatch.context() as m, pytest.raises(Died):
        dying(m, runs, "point", 0)
        step(rows.where("id < 8"))
    out = step(rows).orderBy("number").collect()
    assert [(r.key, r.number) for r in out] == [(str(i), i + 1) for i in range(10)]
    assert step(rows.union(rows)).count() == 10
    done = runs.resumed(spark, path, schema)
    runs.saved(path, done[0], done[1], done[2], status="done")
    assert runs.resumed(spark, path, schema)[2] == 1  # a finished run is followed by a new one


def test_a_step_takes_a_repeated_key_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "x")], "key string, at long, name string")
    out = runs.advanced(spark, f"{tmp_path}/r", rows, "key", "key string, name string, number long", "number", "at").collect()
    assert sorted(map(tuple, out)) == [("a", "early", 1), ("b", "x", 2)]


def test_a_work_without_a_patch_stops_the_release(spark):
    works = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    patches = spark.createDataFrame([(1, "c", 0), (2, "d", 0)], "id long, v string, previous int")
    assert sorted(map(tuple, release.released_works(works, patches, "id", "v1").collect())) == [(1, "c", "v1"), (2, "d", "v1")]
    with pytest.raises(Exception, match="no patch for 2"):
        release.released_works(works, patches.where("id = 1"), "id", "v1").collect()


def test_csv_for_spreadsheets(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q",\nb', ["x", "y"]), ("ü", "c\r\nd", []), (None, "", None)], "id string, t string, `tags.x` array<string>")
    files.write_csv(rows.coalesce(1), f"{tmp_path}/w", windows=True)
    raw = next((tmp_path / "w").glob("*.csv")).read_bytes()
    assert raw == '﻿id,t,tags.x\r\n1,"a ""q"",\r\nb",x|y\r\nü,"c\r\nd",\r\n,,\r\n'.encode()
    back = files.csv_records(spark, f"{tmp_path}/w", "id string, t string, tags string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", 'a "q",\nb', "x|y"), ("ü", "c\nd", None)]
