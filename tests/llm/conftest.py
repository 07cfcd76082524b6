import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names operators use inside."""
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, "Same text here and there"), (4, "Same text here and there"), (4, "Same text here and there"), (None, "no id, you idiot"), (5, "wörd é 漢字 😀 " * 3000), (6, "a"), (7, "one two"), (8, "x" * 20_000)]
    return spark.createDataFrame([(i, t, None, None, None, "clash", 7, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, blob string, fp long, word string")
