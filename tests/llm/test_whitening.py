import math

import numpy as np
import pytest

from tamiz.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<double>"


def run(spark, rows, schema=SCHEMA, **options):
    found = whitening.whiten(spark.createDataFrame(rows, schema), **options).collect()
    return sorted(found, key=lambda r: (repr(r[0]), r["component"], r["deviation"], r["whitened"]))


def brute(rows, k=8):
    """Eigenvectors of the covariance, from exact centred rows."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in usable], object)
    n, s = len(x), x.sum(0)
    d = x * n - s
    centred = (d / n).astype(float)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:k]
    return [i for i, _ in usable], n, [int(a) for a in (d * d).sum(1)], centred, e[order], q[:, order], e.sum()


def check(spark, rows, k=8):
    ids, n, deviations, centred, e, q, total = brute(rows, k)
    got = run(spark, rows, components=k)
    k = min(k, centred.shape[1])
    assert len(got) == n * k and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert sorted((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == sorted(zip(ids, deviations))
    assert all(abs(r["explained"] - e[r["component"] - 1] / total) <= 1e-9 for r in got)
    assert max(r["identity_error"] for r in got) <= 1e-9
    w = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    for c in range(k):
        want = centred @ q[:, c] / np.sqrt(e[c])
        mine = np.array([w[i, c + 1] for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8


@pytest.mark.parametrize("n, dim, k", [(300, 12, 8), (40, 3, 8), (2000, 20, 5), (9, 30, 4)])
def test_as_by_brute_force(spark, n, dim, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim)) * (0.1 + np.arange(dim)) + 3
    check(spark, [(i, [float(c) for c in r]) for i, r in enumerate(x)], k)


def test_few_rows_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MEET", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(5)
    check(spark, [(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(100, 6)) * [1, 2, 3, 4, 5, 6.5])])


def test_unusable_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    good = [(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(30, 3)) * [1, 2, 4])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 1.0]), (94, [1.0, float("inf"), 0.0]),
           (95, [1.0, 2.0]), (96, [1e300, 0.0, 0.0])]
    schema = "n int, whitened string, id int, w int, vec_id string, embedding array<float>"
    rows = [(1, "a", 2, 3, str(i), v) for i, v in good + bad if i != 96]
    got = run(spark, rows, schema)
    assert {r["vec_id"] for r in got} == {str(i) for i, _ in good} and got[0]["n"] == 30
    assert {r["vec_id"] for r in run(spark, good + bad)} == {i for i, _ in good}
    twice = good + [good[0], good[0], (None, good[1][1]), (None, None)]
    got = run(spark, twice)
    assert len(got) == 33 * 3 and sum(r["vec_id"] is None for r in got) == 3


def test_no_variance(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []
    for rows in ([(1, [0.5, 2.0])], [(i, [0.5, 2.0]) for i in range(9)]):
        got = run(spark, rows)
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, 0.0, 0.0, 0.0)}
        assert len(got) == 2 * len(rows)
    got = run(spark, [(i, [float(i), 7.0, float(-i)]) for i in range(10)])
    assert all(r["explained"] == (pytest.approx(1) if r["component"] == 1 else 0) for r in got)
    assert all(r["whitened"] == 0 for r in got if r["component"] > 1) and got[0]["identity_error"] < 1e-9


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float((-1) ** i * 2**31), float(i)]) for i in range(50)]
    _, _, deviations, *_ = brute(rows)
    got = run(spark, rows)
    assert [int(r["deviation"]) for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == 1] == deviations
    assert max(deviations) > 1 << 63


def matrices():
    rng = np.random.default_rng(0)
    q, p = (np.linalg.qr(rng.normal(size=(64, 64)))[0] for _ in "qp")
    yield from (rng.normal(size=(n, n)) for n in (1, 2, 3, 5, 64, 150))
    yield from (np.zeros((5, 5)), np.eye(20) * 3, np.outer(rng.normal(size=30), rng.normal(size=30)), q)
    yield from (np.linalg.qr(rng.normal(size=(64, 64)) * s)[1] for s in (np.logspace(0, -12, 64), np.logspace(-12, 0, 64)))
    x = rng.normal(size=(500, 20))
    yield np.linalg.qr(np.hstack([x, x, x]))[1]
    yield q @ np.diag(np.r_[1 + 1e-10 * rng.normal(size=12), np.full(52, 0.3)]) @ p
    yield q @ np.diag(1 + 1e-6 * np.arange(64)) @ p
    wilkinson = np.diag(np.abs(np.arange(-10, 11.0)) + 11) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield np.linalg.cholesky(wilkinson).T


@pytest.mark.parametrize("r", list(matrices()))
def test_singular_values_and_vectors(r):
    a, b, v = bidiagonal.bidiagonalise(r)
    found = bidiagonal.squared_singular_values(a, b)
    want = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False) ** 2
    assert np.abs(found - want).max() <= 1e-13 * want.max()
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-13
    k = min(8, len(r))
    values, vectors = bidiagonal.leading_vectors(r, k)
    assert np.abs(values - want[:k]).max() <= 1e-13 * want.max()
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(r.T @ r @ vectors - vectors * values).max() <= 1e-12 * max(want.max(), 1e-300)


def test_small_values_are_accurate():
    """Of a graded bidiagonal matrix, by their product, and the exact ones
    of a two by two one."""
    a, b = np.logspace(0, -24, 40), np.logspace(0, -24, 40)[:-1] * 0.5
    found = bidiagonal.squared_singular_values(a, b)
    assert np.log(found).sum() / 2 == pytest.approx(np.log(a).sum(), rel=1e-12)
    assert bidiagonal.squared_singular_values(np.array([1.0, 1e-10]), np.array([1.0]))[1] == pytest.approx(5e-21, rel=1e-12)
