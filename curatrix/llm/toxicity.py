"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are rates: hits in a lexicon learned from labels (words, and beginnings of words, significantly more frequent
in toxic rows) and in a short fixed list of insults, hits near second-person words, capitals, punctuation, and
obfuscated spellings, which are undone before look-up. Of the labelled rows outside the held-out fold a documented,
bounded sample is used: part of its folds for the lexicon, part for the trees, part for the calibration. An id of the
sample with several rows counts once, by the text of the smallest hash.

Every significant term of the bounded sample is in the lexicon, so the sample bounds it.

Defined cases: null and empty texts have zero features; a very long text counts whole; of an id's labels the larger
counts, and of a word's entries the one of most weight; repeated rows get equal scores; rows with a null id are kept;
labels that are null or not 0 or 1 are ignored; where either label is missing in a part of the sample, the score is
the sample's share of label 1 (0 without labels); an empty table gives an empty result; other columns, of whatever
names, are ignored, and ``accepted`` keeps them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import characters, fold, one_each, sliced, strings, texts, written

#: Most labelled rows used; least toxic rows of a lexicon entry; least z value; trees and their depth.
SAMPLE, SUPPORT, SIGNIFICANT, TREES, DEPTH = 20_000, 4, 3.5, 25, 3
FOLDS, HELD = 5, 0
#: Words that address the reader, and insults, in the corpus languages.
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tus usted ustedes vosotros".split())
INSULTS = frozenset("idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb imbecile fool crap bastard bitch asshole shit fuck fucking connard salope imbécile débile crétin ordure arschloch scheiße dummkopf trottel abschaum idiota imbécil estúpido estúpida basura escoria payaso".split())
_UNDO = str.maketrans("013457@$!", "oieastasi")
_INNER = re.compile(r"(?<=\w)[*._\-~+|]+(?=\w)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_LONG = re.compile(r"(.)\1{2,}")
NAMES = ("lexicon", "weighted", "strongest", "hits", "distinct", "insults", "near_you", "you", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "obfuscated_hits", "length")
PREFIXES = (4, 5, 6, 7)


def plain(word: str) -> tuple[str, bool]:
    """A word's lower-case letters with obfuscation undone, and whether there was any."""
    w = _EDGE.sub("", word.lower()) if not word.isalpha() else word.lower()
    if w.isalpha():
        return _LONG.sub(r"\1\1", w), False
    odd = bool(w) and any(c.isalpha() for c in w)
    undone = _LONG.sub(r"\1\1", _INNER.sub("", w).translate(_UNDO)) if odd else ""
    return (undone, True) if undone.isalpha() else ("", odd)


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a plain word: itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)] if word else []


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            got = [(t, label) for text, label in zip(strings(part.column(0)), part.column(1).to_pylist(), strict=True) for t in {t for w in set(text.split()) for t in terms(plain(w)[0])}]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], names=["term", "label"])


def _lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of the terms significantly more frequent in toxic rows: some of the terms of a bounded sample."""
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = total["n"] or 0, total["toxic"] or 0
    if not toxic or toxic == n:
        return {}
    counts = rows.select("text", "label").mapInArrow(_term_rows, "term string, label int").groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("k")).where(F.col("a") >= SUPPORT)
    a, b = F.col("a") + 0.5, F.col("k") - F.col("a") + 0.5
    odds = F.log(a / (toxic - F.col("a") + 1)) - F.log(b / ((n - toxic) - (F.col("k") - F.col("a")) + 1))
    z = odds / F.sqrt(1 / a + 1 / b)
    best = counts.select("term", odds.alias("w"), z.alias("z")).where(F.col("z") >= SIGNIFICANT).collect()
    return {r["term"]: float(r["w"]) for r in best}


class _Words(dict):
    """Word to weight and flags: 1 reader, 2 insult, 4 obfuscated, 8 shouted; kept up to a number of words."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str) -> complex:
        if len(self) >= self.most:
            self.clear()
        w, odd = plain(word)
        weight = max((self.lexicon.get(t, 0.0) for t in terms(w)), default=0.0)
        flags = (w in YOU) + 2 * (w in INSULTS) + 4 * odd + 8 * (len(word) > 2 and word.isupper())
        out = self[word] = complex(weight, flags)
        return out


def features(text: str, words_of: _Words) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    got = np.fromiter(map(words_of.__getitem__, words), np.complex128, n)
    weight, flags = got.real, got.imag.astype(np.int64)
    insult, hit = flags & 2 > 0, (weight > 0) | (flags & 2 > 0)
    at, you = np.flatnonzero(hit), np.flatnonzero(flags & 1)
    near = int((np.searchsorted(you, at + 5, side="right") > np.searchsorted(you, at - 5)).sum()) if len(at) and len(you) else 0
    chars = dict(characters(text))
    letters = capitals = marks = 0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            capitals += k * c.isupper()
        elif not c.isspace() and not c.isdigit():
            marks += k
    share = 100 / n
    return [
        len(at) * share,
        float(weight.sum()) * share,
        float(weight.max()),
        math.log1p(len(at)),
        math.log1p(len({words[i].lower() for i in at.tolist()})),
        float(insult.sum()) * share,
        near * share,
        len(you) * share,
        capitals / max(letters, 1),
        float((flags & 8 > 0).sum()) * share,
        chars.get("!", 0) * share,
        chars.get("?", 0) * share,
        marks / len(text),
        float((flags & 4 > 0).sum()) * share,
        float(((flags & 4 > 0) & hit).sum()) * share,
        math.log1p(n),
    ]


def _features(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _Words(lexicon)
        for batch in sliced(batches):
            got = [features(t, words_of) for t in strings(batch.column("text"))]
            yield batch.drop_columns(["text"]).append_column("features", pa.array(got, pa.list_(pa.float64())))

    return run


class Model:
    def __init__(self, lexicon: dict[str, float], trees=None, calibration=None, prior: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior


def _margin(trees, rows: DataFrame) -> DataFrame:
    raw = trees.transform(rows.withColumn("features", array_to_vector("features")))
    return raw.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon, trees and calibration from at most ``sample`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    # at most ``sample`` rows of two numbers, so the broadcast is bounded
    chosen = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "doc_id long, label int")
    # at most ``sample`` texts, read again by each step below
    rows = written(one_each(texts(docs, id_col, text_col), chosen).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))))
    share = rows.agg(F.avg("label")).first()[0]
    lexicon = _lexicon(rows.where("part < 2"))
    ready = written(rows.where("part >= 2").mapInArrow(_features(lexicon), "doc_id long, label int, part long, features array<double>").orderBy("doc_id"))
    seen = {(r["part"], r["label"]) for r in ready.groupBy("part", "label").count().collect()}
    if not {(p, y) for p in (2, 3) for y in (0, 1)} <= seen:
        return Model(lexicon, prior=share or 0.0)
    train = ready.where("part = 2").withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=1.0, seed=3).fit(train)
    calibrated = _margin(trees, ready.where("part = 3")).select(F.col("margin"), F.col("label").cast("double").alias("label"))
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(calibrated)
    return Model(lexicon, trees, isotonic, share or 0.0)


def _score(model: Model, rows: DataFrame) -> DataFrame:
    """``rows`` has a column of texts, ``text``; it is replaced by ``score``."""
    if model.trees is None:
        return rows.drop("text").withColumn("score", F.lit(float(model.prior)))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("features", T.ArrayType(T.DoubleType()))
    out = model.calibration.transform(_margin(model.trees, rows.mapInArrow(_features(model.lexicon), schema))).drop("margin")
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)
    out = _score(model, texts(docs, id_col, text_col))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below ``below``; scored where they lie."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _score(fit(docs, labels, text_col=text_col), rows).where(F.col("score") < below).select("row.*")
