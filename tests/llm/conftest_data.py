"""Reads of the small tables without Spark."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def read(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))
    return list(zip(*[t.column(c).to_pylist() for c in columns], strict=True))
