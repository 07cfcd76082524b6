"""Quality by nearest-neighbour voting over latent-semantic vectors.

Every text becomes hashed term counts: words, and marks of form (word shapes, symbol characters, immediate repeats,
repeated lines) in blocks of their own. Document frequencies are counted over all documents. A documented, bounded
sample of labelled rows gives a truncated singular value decomposition; its rows are the labelled latent vectors. They
are broadcast, at most ``SAMPLE`` x ``RANK`` numbers, and each document's cosine products with all of them are
computed exactly, block by block. The ``NEIGHBOURS`` nearest vote with their similarity as weight. An id of the sample
with several rows counts once, by the text of the smallest hash.

Defined cases: null and empty texts have a zero vector and get the sample's share of label 1; a very long text counts
whole; all neighbours as near as the last of the ``NEIGHBOURS`` vote too (cosines are rounded to 4 decimals first, so that
ties don't hang on the order of sums); repeated rows get equal scores; rows with a null id are kept; labels that are null
or not 0 or 1 are ignored; an empty table gives an empty result, no labels give a score of 0.5; other columns, of
whatever names, are ignored, and ``accepted`` keeps them.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import characters, fold, one_each, sliced, strings, texts

#: Most labelled rows used, hashed columns for words and for marks, latent dimensions, neighbours, weight of marks.
SAMPLE, WORDS, MARKS, RANK, NEIGHBOURS, MARK_WEIGHT = 4000, 1 << 11, 1 << 9, 48, 15, 2.5
SCORES = "doc_id long, score double"
_RUN = re.compile(r"(.)\1+", re.S)


class _Memo(dict):
    """Hashed column of each word, kept up to a number of words."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


def _form(c: str) -> str:
    return "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c


_ASCII = str.maketrans({chr(i): _form(chr(i)) for i in range(128)})


def _shape(word: str) -> str:
    """The word's form: letters as x or X, digits as 0, symbols as they are, runs cut to one."""
    return _RUN.sub(r"\1", word.translate(_ASCII) if word.isascii() else "".join(map(_form, word)))


@functools.lru_cache(maxsize=50_000)
def _shape_column(shape: str) -> int:
    return zlib.crc32(("shape " + shape).encode()) % MARKS


def _word_columns(word: str) -> int:
    """The columns of the word and of its shape, as one number."""
    return zlib.crc32(word.lower().encode()) % WORDS * MARKS + _shape_column(_shape(word))


def _mark(name: str) -> int:
    return WORDS + zlib.crc32(name.encode()) % MARKS


_REPEAT, _SAME_LINE, _SHORT_LINE, _FEW = (_mark(n) for n in ("repeated word", "repeated line", "short line", "distinct words"))


def _symbol(char: str) -> int:
    return -1 if char.isalnum() or char.isspace() else _mark("symbol " + char)


def term_counts(text: str, words_of: _Memo, symbols: _Memo) -> np.ndarray:
    """Counts by hashed column; the marks are rates per hundred words."""
    words = text.split()
    out = np.zeros(WORDS + MARKS, np.float32)
    if not words:
        return out
    codes = np.fromiter(map(words_of.__getitem__, words), np.int64, len(words))
    out[:WORDS] = np.bincount(codes // MARKS, minlength=WORDS)
    out[WORDS:] = np.bincount(codes % MARKS, minlength=MARKS)
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    out[_REPEAT] += int((codes[1:] == codes[:-1]).sum())
    out[_SAME_LINE] += len(lines) - len(set(lines))
    out[_SHORT_LINE] += sum(len(x) < 20 for x in lines)
    out[_FEW] += len(words) - len(set(words))
    for c, n in characters(text):
        if (at := symbols[c]) >= 0:
            out[at] += n
    out[WORDS:] *= 100 / len(words)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped counts times inverse document frequency; words and marks each scaled to a fixed length."""
    x = np.log1p(counts)
    x *= idf
    for part, weight in ((slice(0, WORDS), 1.0), (slice(WORDS, None), MARK_WEIGHT)):
        size = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= weight / np.where(size > 0, size, 1)
    return x


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, np.ndarray, pa.RecordBatch]]:
    words_of, symbols = _Memo(_word_columns), _Memo(_symbol)
    for part in sliced(batches, rows):
        yield part.column(0), np.stack([term_counts(t, words_of, symbols) for t in strings(part.column(1))]), part


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, seen = 0, np.zeros(WORDS + MARKS, np.int64)
    for _, counts, _ in _chunks(batches):
        n += len(counts)
        seen += (counts > 0).sum(axis=0)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([n, *seen[at].tolist()], pa.int64())], names=["term", "n"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, counts, part in _chunks(batches):
        at = [np.flatnonzero(c).astype(np.int32) for c in counts]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([a.tolist() for a in at], pa.list_(pa.int32())), pa.array([c[a].tolist() for a, c in zip(at, counts, strict=True)], pa.list_(pa.float32()))], names=["doc_id", "label", "terms", "counts"])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, folds: int, held: int) -> DataFrame:
    """doc_id and label of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


class Model:
    """idf, projection, labelled latent vectors, their labels, and the score where nothing is similar."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = weighted(counts, self.idf) @ self.basis
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def score(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = np.round(self.latent(counts) @ self.vectors.T, 4)
        k = min(neighbours, cosines.shape[1])
        last = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, cosines.shape[1] - k]
        out = np.full(len(counts), self.prior)
        for i in np.flatnonzero(last > -1).tolist():
            near = np.flatnonzero(cosines[i] >= last[i])
            weight = np.maximum(cosines[i, near], 0).astype(np.float64) ** 4
            if weight.any():
                out[i] = (weight * self.labels[near]).sum() / weight.sum()
        return np.round(out, 9)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Statistics of all documents, decomposition of the bounded sample."""
    spark, plain = docs.sparkSession, texts(docs, id_col, text_col)
    rows = plain.mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = sum(r["n"] for r in rows if r["term"] == -1)
    seen = np.zeros(WORDS + MARKS)
    for r in rows:
        if r["term"] >= 0:
            seen[r["term"]] = r["n"]
    idf = (np.log((n + 1) / (seen + 1)) + 0.1).astype(np.float32)
    # at most ``sample`` rows of two numbers, so the broadcast is bounded
    chosen = labelled_sample(docs, labels, "quality", sample, folds, held).collect()
    chosen = spark.createDataFrame([(r["doc_id"], r["label"]) for r in chosen], "doc_id long, label int")
    got = sorted(one_each(plain, chosen).select("doc_id", "text", "label").mapInArrow(_sample_counts, "doc_id long, label int, terms array<int>, counts array<float>").collect(), key=lambda r: r["doc_id"])
    counts = np.zeros((len(got), WORDS + MARKS), np.float32)
    for i, r in enumerate(got):
        counts[i, r["terms"]] = r["counts"]
    y = np.array([r["label"] for r in got], np.float64)
    if not len(got):
        return Model(idf, np.zeros((WORDS + MARKS, 1), np.float32), np.zeros((0, 1), np.float32), y)
    x = weighted(counts, idf)
    del counts
    basis = _basis(x, min(rank, *x.shape))
    model = Model(idf, basis, x @ basis, y)
    model.vectors = model.vectors / np.maximum(np.linalg.norm(model.vectors, axis=1, keepdims=True), 1e-12)
    return model


def _basis(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by randomised subspace iteration with a fixed start."""
    rng = np.random.default_rng(7)
    q = rng.normal(size=(x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T[:, :rank]).astype(np.float32)


def _scorer(shared, neighbours: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, counts, _ in _chunks(batches):
            score = model.score(counts, neighbours)
            score[~counts.any(axis=1)] = model.prior
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = model or fit(docs, labels, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    got = texts(docs, id_col, text_col).mapInArrow(_scorer(shared, neighbours), SCORES)
    return got.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _acceptor(shared, neighbours: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words_of, symbols = _Memo(_word_columns), _Memo(_symbol)
        for part in sliced(batches, 256):
            counts = np.stack([term_counts(t, words_of, symbols) for t in strings(part.column(1))])
            score = model.score(counts, neighbours)
            score[~counts.any(axis=1)] = model.prior
            yield part.filter(pa.array(score >= least))

    return run


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, neighbours: int = NEIGHBOURS, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``least``; scored where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col=text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_acceptor(shared, neighbours, least), rows.schema).select("row.*")
