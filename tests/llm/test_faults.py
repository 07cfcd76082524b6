"""Texts and columns that once ended a job."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest_data import SF
from curatrix.llm import blob_ledger, bpe_words, knn_quality, pii_surrogates, slack_packing, toxicity


@pytest.mark.parametrize("text", ["x@" + "a." * 100_000 + "com", "x@" + "a." * 100_000, "a." * 100_000 + "@b.com", "DE12" + " 1234" * 100_000, "0" + "12 " * 100_000, "-" * 300_000 + "1", "1-" * 100_000, "Mr " * 200 + "John Smith"], ids=range(8))
def test_very_long_entities(spark, text):
    docs = spark.createDataFrame([(1, text), (2, "mail j.doe@mail.example.com. Bye")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii_surrogates.replaced(docs).collect()}
    assert set(out) == {1, 2} and "j.doe" not in str(out[2])


def test_mail_addresses_end_with_letters(spark):
    found = spark.createDataFrame([("a@b.com x@y.co.uk, u@v.com1 p@q.r s@t.com..de m@n-o.museum.",)], "t string").select(F.regexp_extract_all("t", F.lit(pii_surrogates.PATTERNS["email"]), F.lit(0))).first()[0]
    assert found == ["a@b.com", "x@y.co.uk", "u@v.com", "s@t.com", "m@n-o.museum"]


def test_stages_take_dotted_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("a.b", F.col("doc_id") + 1)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for stage in (knn_quality.accepted, toxicity.accepted):
        out = stage(docs, labels)
        assert out.columns == docs.columns
        assert out.where("`a.b` = doc_id + 1").count() == out.count() > 0
    for _, stage in corpus_pipeline.STAGES[2:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF20746F6B656E3D6162636465666768' AS STRING) AS text UNION ALL SELECT 2L, 'plain'")
    same = spark.createDataFrame([(1, "a� token=abcdefgh"), (2, "plain")], "doc_id long, text string")
    for one in (bpe_words.digests, slack_packing.pack, lambda d: blob_ledger.digest(blob_ledger.findings(d)).drop("blob")):
        key = [c for c in one(same).columns if c not in ("sequence_id", "offset")]
        assert Counter(map(str, one(docs).select(*key).collect())) == Counter(map(str, one(same).select(*key).collect()))
    assert {r.doc_id: r.text for r in blob_ledger.redact(docs).collect()}[1] == "a� [SECRET]"
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert knn_quality.scored(docs, labels).count() == toxicity.scored(docs, labels).count() == 2
