"""Control tables: short tables of fixed values that come with the package as CSV files."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


def control_table(spark: SparkSession, name: str) -> DataFrame:
    """``place`` (from 1) and the columns of a control table, all texts. The files have a few hundred lines at most, so the
    driver reads them."""
    lines = resources.files("curatrix.data").joinpath(f"{name}.csv").read_text("utf-8").splitlines()
    header, *rows = csv.reader(line for line in lines if line and not line.startswith("#"))
    return spark.createDataFrame([(n, *row) for n, row in enumerate(rows, 1)], ", ".join(["place int", *[f"`{c}` string" for c in header]]))
