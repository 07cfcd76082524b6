"""Look-ups by id and by text, against brute force."""

import hashlib
import unicodedata

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from curatrix.operators import resolve, retrieval
from curatrix.plans import shapes

SF = "/root/testdata/sf0.001"


def test_lookup_texts_of_all_documents(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c)[0] not in "MPSZ" and not c.isspace()).lower()
    want = sorted((r["doc_id"], r["text"] and hashlib.md5(plain(r["text"]).encode()).hexdigest()) for r in rows)
    got = sorted(map(tuple, shapes.QUERIES["lookup_texts"](spark, SF).collect()))
    assert got == want and any(not r["text"].isascii() for r in rows if r["text"])


def test_ids_found_hidden_and_absent(spark):
    rows = spark.createDataFrame([("a", "7", "x", False), ("b", "7", "y", True), ("c", None, "z", None), ("artwork_9", "8", "w", False)], "_id string, other string, v string, gone boolean")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("artwork_7",), ("7",), ("artwork_9",), ("artwork_8",), ("zz",), ("",), (None,), ("a",)], "asked string")
    got = {r.asked: (r.answer, r._id, r.v) for r in retrieval.pointed(asked, rows, "_id", "other", "artwork_", F.col("gone")).collect()}
    assert got == {"a": ("found", "a", "x"), "b": ("hidden", None, None), "c": ("found", "c", "z"), "artwork_7": ("found", "a", "x"), "7": ("found", "a", "x"), "artwork_9": ("found", "artwork_9", "w"), "artwork_8": ("found", "artwork_9", "w"), "zz": ("absent", None, None)}


def test_containment_ignores_marks_and_punctuation(spark):
    index = resolve.alias_index(spark.createDataFrame([("c", ["Cézanne, Paul"]), ("d", ["cezanne paul"]), ("e", ["van Gogh"])], "id string, n array<string>"), "id", F.col("n"))
    texts = spark.createDataFrame([(1, "by VAN-GOGH."), (2, "Cezanne (Paul) "), (3, "vangogh and cézanne; paul")], "k long, t string")
    assert [(r.k, r.id) for r in resolve.uniquely_contained(texts, "k", "t", index).collect()] == [(1, "e")]
