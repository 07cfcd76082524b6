"""The paged source in batch and as a stream, and evidence in levels."""

import json
import sys

import pytest
from pyspark import cloudpickle

from curatrix.operators import evidence
from curatrix.sources import paged

FIELDS = "id long, name string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


class Flaky:
    """Pages under a folder; a file ``broken-<page>`` makes a page fail, and each fetch is noted."""

    def __init__(self, path):
        self.path, self.inner = str(path), paged.Folder(f"file://{path}")

    def pages(self):
        return self.inner.pages()

    def page(self, number):
        import os
        import uuid

        open(f"{self.path}/asked-{number}-{uuid.uuid4().hex}", "w").close()
        if os.path.exists(f"{self.path}/broken-{number}"):
            raise OSError(f"page {number}")
        return self.inner.page(number)


def put(path, number, rows):
    folder = path / f"page={number}"
    folder.mkdir()
    (folder / "a.json").write_text("".join(json.dumps({"id": i, "name": n}) + "\n" for i, n in rows))


def asked(path):
    return sorted(int(x.name.split("-")[1]) for x in path.glob("asked-*"))


def test_batch_reads_all_pages_in_ranges(spark, tmp_path):
    for k in range(7):
        put(tmp_path, k, [(10 * k + j, f"é{j}") for j in range(3)])
    spark.dataSource.register(paged.paged("batch_pages", Flaky(tmp_path), FIELDS))
    rows = spark.read.format("batch_pages").option("parts", 3).load()
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, rows.collect())) == [(k, j, 10 * k + j, f"é{j}") for k in range(7) for j in range(3)]
    assert asked(tmp_path) == list(range(7))
    assert spark.read.format("batch_pages").option("first", 5).load().count() == 6
    assert paged.repeats(rows, "id").count() == 0


def test_a_stream_goes_on_at_the_page_that_failed(spark, tmp_path):
    pages, out, check = tmp_path / "pages", f"{tmp_path}/out", f"{tmp_path}/check"
    pages.mkdir()
    for k in range(3):
        put(pages, k, [(k, "x")])
    spark.dataSource.register(paged.paged("stream_pages", Flaky(pages), FIELDS))

    def run():
        stream = spark.readStream.format("stream_pages").option("parts", 1).option("wait", "0.01").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    run()
    for k in range(3, 6):
        put(pages, k, [(k, "x")])
    (pages / "broken-4").touch()
    with pytest.raises(Exception, match="page 4|STREAM"):
        run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2]
    before = asked(pages)
    assert before.count(4) >= paged.TRIES
    (pages / "broken-4").unlink()
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(6))
    assert [n for n in range(3) if asked(pages).count(n) > before.count(n)] == []  # pages before are not read again


def test_repeated_pages_and_ids_are_reported(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (2, 0, 3), (2, 1, 4), (3, 0, 4), (3, 1, 5), (4, 0, 6), (4, 1, 6)], "page int, place int, id long")
    got = sorted(((r.kind, r.page, r.of, r.key) for r in paged.repeats(rows, "id").collect()), key=str)
    assert got == [("id", 1, 0, "1"), ("id", 1, 0, "2"), ("id", 3, 2, "4"), ("id", 4, 4, "6"), ("page", 1, 0, None)]
    assert sorted((r.page, r.id) for r in paged.sound(rows, "id").collect()) == [(0, 1), (0, 2), (2, 3), (2, 4), (3, 5), (4, 6)]
    assert paged.repeats(rows.limit(0), "id").count() == 0


def test_levels_against_breadth_first_search(spark):
    refs = {f"e{i}": [f"e{(i * 5 + 1) % 40}", f"e{i + 3}", f"gone{i % 3}"] for i in range(30)} | {"self": ["self", None]}
    entities = spark.createDataFrame([(k, v, None) for k, v in refs.items()] + [("e1", ["late"], ["more"])], "key string, a array<string>, b array<string>")
    refs["e1"] += ["late", "more"]
    for depth in (0, 1, 3):
        want, front = {}, {"e0", "self", "none"}
        for level in range(depth + 1):
            want |= dict.fromkeys(front, level)
            front = {r for i in front for r in refs.get(i, []) if r} - set(want)
        start = spark.createDataFrame([("e0",), ("self",), ("none",), (None,), ("e0",)], "id string")
        got = evidence.expanded(start, entities, "key", ["a", "b"], depth).collect()
        assert {r.id: r.level for r in got} == want and len(got) == len(want)
        assert all(r.found == (r.id in refs) for r in got)


def test_evidence_of_creators(spark):
    targets = spark.createDataFrame([(1, "q1", 1840, 1926), (2, "q2", 1850, None), (3, "q3", None, 1900), (4, None, None, None), (5, "q1", 1, None), (6, "q9", 1800, None)], "_id long, entity_id string, birth_year int, death_year int")
    entities = spark.createDataFrame([("q1", "Monet", 1840, 1926, ["p1", "p2", "p1"], None), ("q2", "Q", 1851, 1900, [], ["o1"]), ("q3", "R", 1, 1900, None, None), ("p1", "Paris", None, None, None, None), ("o1", "painter", None, None, None, None)], "id string, label string, birth_year int, death_year int, places array<string>, jobs array<string>")
    got = {r._id: r for r in evidence.evidence(targets, spark.createDataFrame([(5,)], "_id long"), entities, ["places", "jobs"]).collect()}
    assert set(got) == {1, 2, 3, 6}
    assert got[1].places == ["Paris", "", "Paris"] and got[1].jobs == [] and got[1].birth_matches and got[1].death_matches
    assert not got[2].birth_matches and got[2].death_matches and got[2].jobs == ["painter"]
    assert got[3].birth_matches and got[3].their_death == 1900
    assert got[6].label == "" and not got[6].birth_matches and got[6].their_birth is None
