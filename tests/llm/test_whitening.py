"""Whitened vectors against a dense eigensolver."""

import numpy as np
import pytest
from fleetlens.llm.whitening import Fit, Whitening, whitened


def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return made.selectExpr("*", "1 AS n", "2 AS whitened")


def plain(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    real = values > 1e-12 * max(values[0], 0)
    values, axes = values[real], axes[:, real]
    deviation = [int(sum(int(v) ** 2 for v in n * row - s)) for row in x]
    return c @ (axes / np.sqrt(values)), values / (c * c).sum() * n, deviation


def check(rows, found, n=None):
    good = [(i, v) for i, v, _ in rows]
    z, explained, deviation = plain([v for _, v in good])
    k = z.shape[1]
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(found) == len(good) * k
    signs = np.zeros(k)
    for (i, _), row, dev in zip(good, z, deviation, strict=True):
        own = by[i, dev]
        assert sorted(own) == list(range(1, k + 1)) and all(own[c].n == len(good) for c in own)
        mine = np.array([own[c + 1].whitened for c in range(k)])
        signs = np.where(signs == 0, np.sign(mine * row) * (np.abs(row) > 1e-3), signs)
        assert np.abs(mine - np.where(signs == 0, 1, signs) * row).max() < 1e-7
        assert np.allclose([own[c + 1].explained for c in range(k)], explained, rtol=1e-8)
        assert own[1].identity_error < 1e-8


@pytest.mark.parametrize(("dim", "n"), [(3, 40), (20, 100), (64, 400), (90, 60)])
def test_whitened_vectors(spark, dim, n):
    draw = np.random.default_rng(dim)
    table = draw.normal(size=(n, dim)) * 0.9 ** np.arange(dim) + draw.normal(size=dim)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(table)]
    check(rows, whitened(frame(spark, rows)).collect())


def test_flat_spectrum_needs_a_wider_block(spark):
    draw = np.random.default_rng(8)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(draw.normal(size=(3000, 48)))]
    check(rows, whitened(frame(spark, rows), Whitening(extra=1, degree=4, rounds=2)).collect())


def test_rows_that_drop_out_and_rows_that_stay(spark):
    draw = np.random.default_rng(1)
    rows = [(i % 25 if i else None, v.tolist(), None) for i, v in enumerate(draw.normal(size=(50, 5)))]
    rows += [rows[7], rows[7]]
    bad = [(90, None, 1), (91, [1.0, None, 1.0, 1.0, 1.0], 1), (92, [float("nan")] * 5, 1), (93, [1.0, float("-inf"), 0.0, 0.0, 0.0], 1), (94, [], 1)]
    found = whitened(frame(spark, rows + bad)).collect()
    assert len(found) == 52 * 5 and not {r.vec_id for r in found} & set(range(90, 95))
    z, explained, deviation = plain([v for _, v, _ in rows])
    assert sorted(r.deviation for r in found) == sorted(d for d in deviation for _ in range(5))
    assert np.allclose(sorted(abs(r.whitened) for r in found), sorted(np.abs(z).ravel()), atol=1e-7)


def test_lengths_are_fitted_apart(spark):
    draw = np.random.default_rng(2)
    short = [(i, v.tolist(), 1) for i, v in enumerate(draw.normal(size=(30, 2)))]
    long = [(100 + i, v.tolist(), 1) for i, v in enumerate(draw.normal(size=(30, 12)))]
    found = whitened(frame(spark, short + long)).collect()
    check(short, [r for r in found if r.vec_id < 100])
    check(long, [r for r in found if r.vec_id >= 100])


def test_few_directions_and_none(spark):
    line = [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(10)]
    found = whitened(frame(spark, line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 10 and found[0].explained == pytest.approx(1)
    assert whitened(frame(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect() == []
    assert whitened(frame(spark, [])).collect() == []


def test_deviations_beyond_a_long_are_null():
    x = np.array([[2**40, 5], [-(2**40), 5], [100_000, 6]])
    n, s = 3, x.sum(axis=0)
    exact = [sum(int(v) ** 2 for v in n * row.astype(object) - s) for row in x]
    fit = Fit(n, tuple(int(v) for v in s), np.zeros((2, 0)), np.zeros(0), 1.0)
    assert fit.deviations(x) == [d if d < 2**63 else None for d in exact] and None in fit.deviations(x)
    near = x - x + np.array([[3, 4], [5, 6], [9, 1]])
    fit = Fit(n, tuple(int(v) for v in near.sum(axis=0)), np.zeros((2, 0)), np.zeros(0), 1.0)
    assert fit.deviations(near) == [int(((n * row - near.sum(axis=0)) ** 2).sum()) for row in near]
