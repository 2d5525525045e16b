"""Whitening against numpy on whole matrices, and its parts against dense eigendecompositions."""

import math

import numpy as np
import pytest

from sparkclean.llm import queries, whitening
from sparkclean.llm.whitening import Spectrum, deviations, exact_sums, rank_one, secular_roots, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


def close(spectrum, x):
    whole = scatter(x.astype(float))
    scale = max(1.0, np.abs(whole).max())
    assert np.abs(spectrum.vectors @ np.diag(spectrum.values) @ spectrum.vectors.T - whole).max() <= 1e-11 * scale
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(x.shape[1])).max() <= 1e-11
    assert (np.diff(spectrum.values) >= 0).all() and spectrum.n == len(x) and spectrum.sums == x.sum(axis=0).tolist()


def matrices():
    rng = np.random.default_rng(3)
    yield from (rng.integers(0, 400, (250, d)) + 100_000 for d in (1, 2, 7, 20))
    yield np.full((40, 5), 9)  # no variance
    yield np.repeat(rng.integers(-9, 9, (4, 8)), 30, axis=0)  # fewer directions than dimensions
    yield np.outer(np.arange(60), np.arange(1, 7))  # one direction
    yield np.eye(6, dtype=np.int64) * 1000  # equal eigenvalues
    yield np.column_stack([rng.integers(0, 5, 90), rng.integers(0, 10**9, 90), np.zeros(90, np.int64)])
    yield rng.integers(0, 2, (200, 6))


@pytest.mark.parametrize("k", range(len(list(matrices()))))
def test_updates_and_merges_equal_dense(k):
    x = list(matrices())[k]
    whole, left, right = (Spectrum(x.shape[1]) for _ in range(3))
    whole.add(x)
    close(whole, x)
    left.add(x[: len(x) // 3])
    right.add(x[len(x) // 3 :])
    close(left.merge(right), x)


def test_secular_equation():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 9, 40):
        d = np.sort(rng.choice([rng.random(k) * 1e6, np.arange(k) * 1e-3 + rng.random(k) * 1e-4, 10.0 ** np.arange(k) if k < 10 else rng.random(k)]))
        w = rng.random(k) * 10.0 ** rng.integers(-6, 6, k)
        roots, less = secular_roots(d, w)
        dense = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(w, w)))
        assert np.abs(roots - dense).max() <= 1e-12 * np.abs(dense).max()
        assert np.allclose(less, roots[:, None] - d, rtol=0, atol=1e-12 * np.abs(dense).max()) and (np.diff(roots) > 0).all()
    values, vectors = rank_one(np.array([1.0, 1, 1, 2]), np.eye(4), np.array([3.0, 4, 0, 0]), 2.0)
    assert np.allclose(values, [1, 1, 2, 51]) and np.allclose(vectors.T @ vectors, np.eye(4))


def test_exact_integers():
    rng = np.random.default_rng(5)
    for low, high in ((99_000, 101_000), (-(2**61), 2**61)):
        x = rng.integers(low, high, (70, 3))
        sums = exact_sums(x)
        assert sums == [sum(c) for c in x.T.tolist()]
        away, squares = deviations(x, 70, sums)
        assert squares == [sum((70 * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        assert np.allclose(away, [[(70 * v - s) / 70 for v, s in zip(row, sums)] for row in x.tolist()], rtol=1e-15)


def check(found, rows, components=8):
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.array([[math.floor(1024 * float(np.float32(v))) + 100_000 for v in r[1]] for r in kept])
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    order, trace = np.argsort(-values)[:components], values.sum()
    y = (x - sums / n) @ vectors[:, order] / np.sqrt(values[order])
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, len(order) + 1)) and len(found) == n * len(order)
    deviation = sorted((str(r[0]), int(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)))) for r, row in zip(kept, x))
    for c, own in by.items():
        assert sorted((str(r.vec_id), r.deviation) for r in own) == deviation
        assert {r.n for r in own} == {n} and abs(own[0].explained - values[order[c - 1]] / trace) <= 1e-10
        plain = sorted((str(r[0]), v) for r, v in zip(kept, y[:, c - 1]))
        away = (max(abs(a - b) for (_, a), (_, b) in zip(sorted((str(r.vec_id), sign * r.whitened) for r in own), plain)) for sign in (1, -1))
        assert min(away) <= 1e-8
        assert {r.identity_error for r in own} == {found[0].identity_error} and own[0].identity_error <= 1e-9


def test_query_equals_numpy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "GROUP", 2)
    rng = np.random.default_rng(6)
    turn = rng.normal(size=(12, 12))
    rows = [(k, (rng.normal(size=12) * np.arange(1, 13) @ turn * 0.1).tolist(), k % 3, 1, "x") for k in range(200)]
    rows += [(500 + k, rows[7][1], 1, 1, "x") for k in range(100)]  # a common vector
    rows += [(700, None, 1, 1, "x"), (701, [None] * 12, 1, 1, "x"), (702, [math.nan] * 12, 1, 1, "x"), (703, [math.inf] + [0.0] * 11, 1, 1, "x"), (704, [0.0] * 12, 1, 1, "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(queries.op13_whiten_vectors(spark, str(tmp_path)).collect(), rows)


def test_odd_tables(spark):
    of = lambda rows: spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    rng = np.random.default_rng(7)
    rows = [(None, rng.normal(size=3).tolist()) for _ in range(4)] + [(1, [1.0, 2.0, 0.5])] * 2
    check(whiten(of(rows)).collect(), rows)
    assert whiten(of([])).collect() == [] and whiten(of([(1, []), (2, [])])).collect() == [] and whiten(of([(1, None)])).collect() == []
    flat = whiten(of([(k, [1.0, float(k), 1.0]) for k in range(5)])).collect()  # one direction
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert {r.explained for r in flat} == {0.0, 1.0} and flat[0].identity_error < 1e-12
    single = whiten(of([(9, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(9, c, 1, 0, None, 0.0, None) for c in (1, 2)]
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1e30, 1.0])]):
        with pytest.raises(Exception, match="ValueError"):
            whiten(of(bad)).collect()
