"""Whitening against exact fractions and numpy."""

from fractions import Fraction
from math import floor, isfinite, nan

import numpy as np
import pytest
from conftest_data import SF, read

from curatrix.llm import queries, whitening


def check(rows, vectors):
    """``rows`` of the operator for (vec_id, vector) with vectors of one length."""
    kept = [(i, [floor(64 * float(c)) + 1000000 for c in v]) for i, v in vectors if v and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, dim = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dim)]
    centred = [[n * x[k] - sums[k] for k in range(dim)] for x in fit]
    cov = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    top = min(16, dim)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert sorted(map(str, got)) == sorted({str((i, k)) for i, _ in kept for k in range(1, top + 1)})
    assert len(rows) == len(kept) * top
    signs = {}
    for i, x in kept:
        dev = [n * x[k] - sums[k] for k in range(dim)]
        for k in range(top):
            for r in got[i, k + 1]:
                assert r.n == n and r.identity_error <= 1e-4
                assert r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-6, abs=1e-9)
                if values[k] > 1e-9 * np.trace(cov):
                    want = float(np.dot([float(Fraction(d, n)) for d in dev], axes[:, k]) / np.sqrt(values[k]))
                    if abs(want) > 1e-3:
                        signs.setdefault(k, want * r.whitened > 0)
                    assert r.whitened == pytest.approx(want if signs.get(k, True) else -want, abs=1e-4 if n < 3 * dim else 1e-6)
                else:
                    assert r.whitened is None
        assert sum(d * d for d in dev) in {int(r.deviation) for r in got[i, 1]}
    return n


def test_whitening_against_fractions(spark):
    assert check(queries.op12_exact_whitening(spark, SF).collect(), read("embeddings", "vec_id", "embedding")) > 16
    assert dict(queries.op12_exact_whitening(spark, SF).dtypes)["deviation"] == "bigint"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "a", 1) for i, v in vectors], "vec_id long, embedding array<double>, x string, `a.b` int")


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    vectors += [(40, vectors[0][1]), (40, vectors[0][1]), (None, vectors[1][1]), (41, None), (42, []), (43, [1.0, None, 2.0]), (44, [1.0, nan, 2.0]), (45, [1.0, float("inf"), 2.0])]
    assert check(whitening.whitened(frame(spark, vectors)).collect(), vectors) == 30
    assert whitening.whitened(frame(spark, vectors).limit(0)).count() == 0


def test_whitening_needs_any_size_of_integers(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=4) * [1e12, 3e12, 1e11, 2e12] + 1e13).tolist()) for i in range(50)]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_each_length_has_its_own_fit(spark):
    rng = np.random.default_rng(3)
    short, long = [(i, rng.normal(size=2).tolist()) for i in range(12)], [(i + 100, rng.normal(size=5).tolist()) for i in range(40)]
    rows = whitening.whitened(frame(spark, short + long)).collect()
    check([r for r in rows if r.vec_id < 100], short)
    check([r for r in rows if r.vec_id >= 100], long)


def test_models_beyond_the_sent_size_go_in_turn(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(size=2 + i % 3).tolist()) for i in range(60)]
    whole = whitening.whitened(frame(spark, vectors)).orderBy("vec_id", "component").drop("identity_error").collect()
    monkeypatch.setattr(whitening, "SENT", 1)
    assert whitening.whitened(frame(spark, vectors)).orderBy("vec_id", "component").drop("identity_error").collect() == whole


def test_too_few_vectors_have_no_whitened_values(spark):
    rows = whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, 0.0, 0.0)}
    rows = whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [1.5, 0.25])])).collect()
    assert sorted((r.component, r.whitened) for r in rows if r.component == 2) == [(2, None)] * 2
    assert sorted(abs(r.whitened) for r in rows if r.component == 1) == [1.0, 1.0]


def test_scatter_is_exact_over_many_limbs():
    rng = np.random.default_rng(6)
    d = rng.integers(-(2**61), 2**61, size=(5000, 3))
    s = whitening.Scatter(3)
    s.add(d[:1700])
    s.add(d[1700:])
    total = {}
    for i, j, limb, v in s.cells():
        total[i, j] = total.get((i, j), 0) + (v << (whitening.WIRE * limb))
    o = d.astype(object)
    assert all(total[i, -1] == o[:, i].sum() for i in range(3))
    assert all(total[i, j] == (o[:, i] * o[:, j]).sum() for i in range(3) for j in range(i + 1))


def test_partitions_do_not_matter(spark):
    x = whitening.integers(spark.read.parquet(f"{SF}/embeddings.parquet")).select("x").distinct()
    a, b = (whitening.models(y).collect() for y in (x, x.repartition(7)))
    assert a == b and len(a) == 1
