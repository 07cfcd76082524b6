"""Whitening of embeddings from an exact integer scatter matrix.

Components become integers. Over the distinct vectors, with a shift subtracted that keeps numbers small, each task adds up
sums and cross-products exactly: matrix products of 20-bit limbs stay below 2^53, and the totals are integers of any size.
They travel as 30-bit limbs that Spark adds up, cell by cell. n * XtX - S * St is formed in integers and only then becomes
floating point for the eigenvectors, so the fit doesn't depend on how rows were dealt out.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of different
lengths have covariances of their own, one fit per length; repeated vectors count once in the fit, and each row gets its
result; rows with a null id are kept; components beyond 2^61 / 64 count as that; eigenvectors have their largest entry
positive (the first of equal ones), equal eigenvalues stand in the order of the decomposition; a component whose eigenvalue
is at most 1e-10 of the trace (too few distinct vectors) can't be whitened: null, and left out of the identity error; an
empty table gives an empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import written

#: Bits of a limb in matrix products, rows per product and products per sum of machine integers: 2 * 20 + 12 < 53, + 9 < 63.
BITS, ROWS, SUMS = 20, 1 << 12, 1 << 9
#: Bits of a limb on its way between tasks.
WIRE = 30
#: Bytes of models that are sent out at once; more lengths than that are worked off in turn.
SENT = 32 << 20
NONE = 1e-10


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id and the vector as floor(scale * component) + offset."""
    c, most = F.col(vec_col), float(1 << 61)
    good = F.forall(c, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(c, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))) + F.lit(offset))
    return rows.where(c.isNotNull()).where(good & (F.size(c) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _limbs(d: np.ndarray) -> list[np.ndarray]:
    """Matrices whose sum, the k-th times 2^(BITS * k), is d."""
    out = []
    while d.size and int(np.abs(d).max()) > 1 << BITS:
        out.append((d & ((1 << BITS) - 1)).astype(np.float64))
        d = d >> BITS
    return [*out, d.astype(np.float64)]


class Scatter:
    """Exact sums and cross-products of integer rows."""

    def __init__(self, dim: int):
        self.sums, self.cross = np.zeros(dim, object), np.zeros((dim, dim), object)
        self.waiting: dict[tuple[int, int], np.ndarray] = {}
        self.added = 0

    def add(self, d: np.ndarray) -> None:
        for at in range(0, len(d), ROWS):
            parts = _limbs(d[at : at + ROWS])
            for k, a in enumerate(parts):
                self._wait((k, -1), a.sum(axis=0))
                for j, b in enumerate(parts):
                    self._wait((k, j), a.T @ b)
            self.added += 1
            if self.added == SUMS:
                self.settle()

    def _wait(self, key: tuple[int, int], exact: np.ndarray) -> None:
        exact = exact.astype(np.int64)
        self.waiting[key] = self.waiting[key] + exact if key in self.waiting else exact

    def settle(self) -> None:
        for (k, j), total in self.waiting.items():
            if j < 0:
                self.sums = self.sums + total.astype(object) * (1 << BITS * k)
            else:
                self.cross = self.cross + total.astype(object) * (1 << BITS * (k + j))
        self.waiting, self.added = {}, 0

    def cells(self) -> Iterator[tuple[int, int, int, int]]:
        """(row, column or -1 for the sum, limb, value), limbs but the last not negative."""
        self.settle()
        for i in range(len(self.sums)):
            for j in range(-1, i + 1):
                v, limb = int(self.sums[i] if j < 0 else self.cross[i, j]), 0
                while v > (1 << WIRE) or v < -(1 << WIRE):
                    yield i, j, limb, v & ((1 << WIRE) - 1)
                    v >>= WIRE
                    limb += 1
                yield i, j, limb, v


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batch's vectors by length: length, row numbers, matrix."""
    x = batch.column("x")
    sizes = np.diff(x.offsets.to_numpy())
    begins, values = x.offsets.to_numpy()[:-1], x.values.to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, values[begins[at][:, None] + np.arange(dim)]


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Scatter] = {}
    for batch in batches:
        shift = batch.column("shift").to_numpy()
        for dim, at, x in _matrices(batch):
            held.setdefault(dim, Scatter(dim)).add(x - shift[at][:, None])
    for dim, s in held.items():
        rows = np.array(list(s.cells()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), *(pa.array(rows[:, k].astype(np.int32)) for k in range(3)), pa.array(rows[:, 3])], names=["dim", "i", "j", "limb", "value"])


MODEL = "dim int, n long, shift long, sums array<string>, roots array<double>, vectors array<double>, explained array<double>"


def _fitted(components: int):
    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        dim, n, shift = int(cells["dim"].iloc[0]), int(cells["n"].iloc[0]), int(cells["shift"].iloc[0])
        sums, cross = np.zeros(dim, object), np.zeros((dim, dim), object)
        for i, j, limb, total in zip(*(cells[c].tolist() for c in ("i", "j", "limb", "total")), strict=True):
            if j < 0:
                sums[i] += total << (WIRE * limb)
            else:
                cross[i, j] += total << (WIRE * limb)
        low = n * cross - np.outer(sums, sums)
        exact = [[int(low[max(i, j), min(i, j)]) for j in range(dim)] for i in range(dim)]
        v = np.array([[c / n**2 for c in row] for row in exact])
        trace = sum(exact[i][i] for i in range(dim)) / n**2
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
        heads = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
        vectors = vectors * np.where(heads < 0, -1.0, 1.0)[:, None]
        roots = np.where(values > NONE * trace, np.sqrt(values), 0.0)
        explained = values / trace if trace else np.zeros(len(values))
        return pd.DataFrame({"dim": [dim], "n": [n], "shift": [shift], "sums": [[str(s) for s in sums]], "roots": [roots], "vectors": [vectors.ravel()], "explained": [explained]})

    return fit


def models(fit: DataFrame, components: int = 16) -> DataFrame:
    """One row per length of ``fit``'s distinct vectors x: their number, shift, shifted sums (exact, as digits), and of
    the first components the square roots of eigenvalues (0: none), eigenvectors row by row, and shares of the trace."""
    sized = fit.withColumn("dim", F.size("x"))
    bounds = sized.groupBy("dim").agg(F.count("*").alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    shifts = bounds.select("dim", "n", (F.col("low") + F.shiftright(F.col("high") - F.col("low"), 1)).alias("shift"))
    cells = sized.join(shifts.select("dim", "shift"), "dim").select("x", "shift").mapInArrow(_scatter, "dim int, i int, j int, limb int, value long")
    totals = cells.groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("total"))
    return totals.join(shifts, "dim").groupBy("dim").applyInPandas(_fitted(components), MODEL)


class Model(NamedTuple):
    n: int
    shift: int
    sums: np.ndarray
    roots: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @classmethod
    def of(cls, row) -> Model:
        return cls(row.n, row.shift, np.array([int(s) for s in row.sums], object), np.array(row.roots), np.array(row.vectors).reshape(len(row.roots), row.dim), np.array(row.explained))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: machine integers as long as they hold it."""
        d = x - self.shift
        if max(int(np.abs(d).max(initial=0)) * self.n, max(map(abs, self.sums))) < 1 << 61:
            return d * self.n - self.sums.astype(np.int64)
        return d.astype(object) * self.n - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows by component; components without an eigenvalue are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred / self.n).astype(np.float64) @ self.vectors.T / self.roots
        out[:, self.roots == 0] = np.nan
        return out

    @staticmethod
    def deviation(centred: np.ndarray) -> list[int]:
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 62:
            return (centred * centred).sum(axis=1).tolist()
        return [sum(v * v for v in map(int, row)) for row in centred]


def _measure(known):
    """Sums of whitened values and of their products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrices(batch):
                m = known.value[dim]
                w = np.nan_to_num(m.whitened(m.centred(x)))
                held[dim] = held.get(dim, 0) + np.vstack([w.sum(axis=0), w.T @ w])
        for dim, total in held.items():
            k = total.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim, np.int32)), pa.array(np.repeat(np.arange(-1, k, dtype=np.int32), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), k + 1)), pa.array(total.ravel())], names=["dim", "i", "j", "value"])

    return run


def _worst(total: np.ndarray, m: Model) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    on = m.roots > 0
    mean = total[0] / m.n
    gap = np.abs(total[1:] / m.n - np.outer(mean, mean) - np.eye(len(on)))[on][:, on]
    return float(gap.max(initial=0.0))


def _rows(known, errors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch):
                m = known.value[dim]
                centred = m.centred(x)
                w, k = m.whitened(centred), len(m.roots)
                each = pa.array(np.repeat(np.arange(len(at)), k))
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in m.deviation(centred)], pa.decimal128(38, 0))
                columns = {
                    "vec_id": batch.column("vec_id").take(pa.array(at)).take(each),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(len(each), m.n, np.int64)),
                    "deviation": deviation.take(each),
                    "whitened": pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    "explained": pa.array(np.tile(m.explained, len(at))),
                    "identity_error": pa.array(np.full(len(each), errors[dim])),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _slices(models: DataFrame) -> Iterator[list[int]]:
    """Lengths whose models may be sent out together."""
    some, size = [], 0
    for dim, n in models.select("dim", F.size("roots")).orderBy("dim").collect():
        if some and size + 8 * dim * (n + 2) > SENT:
            yield some
            some, size = [], 0
        some.append(dim)
        size += 8 * dim * (n + 2)
    if some:
        yield some


def whitened(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal; null from 10^38), whitened, explained and identity_error for each row that
    takes part and each component, numbered from 1 by falling eigenvalue."""
    spark, x = rows.sparkSession, integers(rows, id_col, vec_col)
    fit = written(x.select("x").distinct())
    fits = written(models(fit, components))
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = None
    for dims in _slices(fits):
        some = {r.dim: Model.of(r) for r in fits.where(F.col("dim").between(dims[0], dims[-1])).collect()}
        known = spark.sparkContext.broadcast(some)
        within = F.size("x").between(dims[0], dims[-1])
        sums = fit.where(within).mapInArrow(_measure(known), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
        totals = {d: np.zeros((len(m.roots) + 1, len(m.roots))) for d, m in some.items()}
        for dim, i, j, value in sums.collect():
            totals[dim][i + 1, j] = value
        errors = {d: _worst(totals[d], m) for d, m in some.items()}
        part = x.where(within).mapInArrow(_rows(known, errors), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
