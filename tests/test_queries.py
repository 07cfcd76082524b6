"""Every registered query of the catalogue against its SQL."""

import decimal

import duckdb
import pytest

from curatrix.plans import checks, enrich, feeds, governance, library, recommend, records, searches, serving, shapes, streams, taxonomy, transfers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = serving.QUERIES | records.QUERIES | governance.QUERIES | library.QUERIES | shapes.QUERIES | checks.QUERIES | enrich.QUERIES | transfers.QUERIES | feeds.QUERIES | searches.QUERIES | streams.QUERIES | taxonomy.QUERIES | recommend.QUERIES
SQL = serving.SQL | records.SQL | governance.SQL | library.SQL | shapes.SQL | checks.SQL | enrich.SQL | transfers.SQL | feeds.SQL | searches.SQL | streams.SQL | taxonomy.SQL | recommend.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    want = [dict(zip(names, row, strict=True)) for row in got.fetchall()]
    key = lambda r: tuple(str(plain(r[c])) for c in sorted(names))
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
