from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import queries, whitening


def brute(vectors, components=16):
    """n, S, and the covariance in exact fractions, then floating-point eigenvectors."""
    x = [tuple(int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, size = len(fit), len(fit[0])
    sums = [sum(v[d] for v in fit) for d in range(size)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in fit) / n) for j in range(size)] for i in range(size)])
    return x, n, sums, cov


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<float>{extra}")


def test_scatter_is_exact():
    r = np.random.default_rng(1)
    for size, rows, most in ((1, 1, 1), (3, 5, 2), (7, 130, 40), (5, 64, 1 << 20), (4, 100, 1 << 39)):
        z = r.integers(-most, most, (rows, size))
        sums, products = whitening.scatter(z)
        wide = z.astype(object)
        assert list(sums) == list(wide.sum(axis=0))
        assert all(products[i, j] == (wide[:, i] * wide[:, j]).sum() for i in range(size) for j in range(i, size))


def test_keys_are_one_to_one():
    r = np.random.default_rng(2)
    z = np.array([[1, 2], [1 << 20, 2], [1, 2], [-(1 << 35), 0], *r.integers(-5, 5, (50, 2))])
    keys = whitening.keys(z).to_pylist()
    assert [whitening.unpacked(2, k).tolist() for k in keys] == z.tolist()
    assert len(set(keys)) == len({tuple(v) for v in z.tolist()})
    assert whitening.keys(z[:1]).to_pylist() == keys[:1]


def check(out, rows, size):
    kept = [(k, v) for k, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    x, n, sums, cov = brute([[np.float32(c) for c in v] for _, v in kept])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, int((e > e[0] * size * np.finfo(float).eps).sum()))
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted({i for i, _ in kept})
    for (i, _), v in zip(kept, x):
        assert sorted(by[i]) == list(range(1, k + 1))
        for c, r in by[i].items():
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums)) == r.deviation_exact
            assert r.explained == pytest.approx(e[c - 1] / np.trace(cov), rel=1e-9) and r.identity_error < 1e-6
            want = float(np.dot([a - s / n for a, s in zip(v, sums)], u[:, c - 1]) / np.sqrt(e[c - 1]))
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in r.normal(size=20) * np.arange(1, 21)]) for k in range(120)]
    rows += [(200, rows[0][1]), (201, None), (202, [None, *rows[1][1][1:]]), (203, [float("nan"), *rows[1][1][1:]]), (204, [float("inf"), *rows[1][1][1:]]), (205, rows[3][1])]
    df = table(spark, rows)
    check(whitening.whiten(df, whitening.fit(df)).collect(), rows, 20)


def test_whole_table(spark, sf_dir):
    out = queries.op13_whitening(spark, sf_dir)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(out.collect(), rows, 64)


def test_blocks_and_signs(spark, monkeypatch):
    """Results don't depend on the size of blocks or on the partitions."""
    rows = [(k, [float(np.sin(k * d + d)) for d in range(6)]) for k in range(90)]
    one = table(spark, rows)
    first = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(one, whitening.fit(one)).collect()}
    monkeypatch.setattr(whitening, "BLOCK", 7)
    other = one.repartition(5)
    second = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(other, whitening.fit(other)).collect()}
    assert first.keys() == second.keys() and all(abs(first[k] - second[k]) < 1e-9 for k in first)


def test_edges(spark):
    empty = table(spark, [])
    assert whitening.fit(empty) == {} and whitening.whiten(empty, {}).collect() == []
    single = table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whitening.whiten(single, whitening.fit(single)).collect() == []
    odd = spark.createDataFrame([(1, [], 5), (None, [1.0, 0.0], 5), (3, [2.0, 0.0], 5), (4, [4.0], 5), (5, [7.0], 6)], "vec_id long, embedding array<double>, component int")
    out = whitening.whiten(odd, whitening.fit(odd)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, round(abs(r.whitened), 9)) for r in out) == [(0, 1, 2, 1.0), (3, 1, 2, 1.0), (4, 1, 2, 1.0), (5, 1, 2, 1.0)]
    with pytest.raises(Exception, match="no exact products"):
        whitening.fit(table(spark, [(1, [1e30])]))


def test_deviations_beyond_a_long():
    m = whitening.Model(10**9, [10**10, 5], np.eye(2), np.ones(2), 2.0, 0.0)
    z = np.array([[100, -3], [0, 0]])
    assert whitening.deviations(z, m) == [(10**11 - 10**10) ** 2 + (3 * 10**9 + 5) ** 2, 10**20 + 25]
