import numpy as np
import pytest

from tamiz.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(x, first=0):
    return [(first + i, [float(v) for v in r]) for i, r in enumerate(x)]


def brute(rows, k=10, usable=lambda v: v and all(c is not None and np.isfinite(c) for c in v) and any(v)):
    table = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and usable(v)}
    out = {}
    for q in table:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(((table[o] - table[q]) ** 2).sum())), o) for o in table if o != q)
            out[q] = d[:k]
    return out


def run(spark, rows, **options):
    out = {}
    for r in sorted(ann.nearest(spark.createDataFrame(rows, SCHEMA), **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(600, 16))])
    rows = rows_of(x)
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({o for _, o in got[q]} & {o for _, o in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {q: {o: d for d, o in brute(rows, 10**6)[q]} for q in list(want)[:3]}
    for q in exact:
        assert all(s == pytest.approx(exact[q][o], abs=1e-12) for s, o in got[q])
        assert got[q] == sorted(got[q])


def test_small_tables_ties_and_unusable_rows(spark):
    rows = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, []), (8, [0.0, 2.0]), (9, [0.0, -0.0]), (100, [1.0, 1.0]), (None, [1.0, 2.0]), (11, [1.0, 2.0, 3.0]), (1, [0.0, 2.0])]
    got = run(spark, rows)
    assert got == {0: [(1.0, 1), (1.0, 8), (1.0, 100)], 100: [(1.0, 0), (pytest.approx(2**0.5), 1), (pytest.approx(2**0.5), 8)]}


def test_groups_of_equal_vectors(spark):
    """Ids among thousands of copies: the smallest, for queries in the group
    and for those nearest to it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 8))
    x[rng.permutation(4000)[:2500]] = x[0]
    x[[100, 300]] = x[0]
    x[[200, 400]] = x[0] + 0.001
    rows = rows_of(x)
    got, want = run(spark, rows), brute(rows)
    for q in (0, 100, 200, 300, 400):
        assert [o for _, o in got[q]] == [o for _, o in want[q]]


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 20, v) for i, v in rows_of(rng.normal(size=(150, 4)))]
    assert run(spark, rows, query_bytes=64) == run(spark, rows)


def test_nothing(spark):
    assert run(spark, []) == {} and run(spark, [(0, [0.0])]) == {} and run(spark, [(100, [1.0])]) == {}
