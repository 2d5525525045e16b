"""Top-k search and near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclean.llm import topk, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, score long, component_id long, node string"


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6)], k % 3) for k in range(40)]
    rows += [(100 + k, rows[k][1], k % 3) for k in range(8)]  # copies
    rows += [(120 + k, [x * 3 for x in rows[5][1]], 2) for k in range(3)]  # the same direction
    rows += [(140, None, 1), (141, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (142, [math.nan] * 6, 1), (143, [math.inf, 1.0, 2.0, 3.0, 4.0, 5.0], 1), (144, [0.0] * 6, 1),
             (145, [1.0, 2.0], 1), (146, [2.0, 4.0], 1), (147, [], 1), (None, rows[0][1], 0), (148, rows[0][1], None), rows[3], rows[3], (160, [0.5], 2), (161, [-0.5], 2)]
    return [(*r, 7, 8, "x") for r in rows]


def quantised(vector):
    able = vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    return tuple(math.floor(64 * float(np.float32(x))) for x in vector) if able else None


def plain_top(rows, k):
    vectors = [(r[0], q) for r in rows if r[0] is not None and (q := quantised(r[1])) is not None]
    out = []
    for n, (a, x) in enumerate(vectors):
        if a % 20 == 0:
            near = sorted((-sum(p * q for p, q in zip(x, y)), b) for m, (b, y) in enumerate(vectors) if m != n and len(y) == len(x))
            out += [(a, rank, b, -s) for rank, (s, b) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [3, 200])
def test_top_k(spark, k):
    rows = odd_rows()
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=k).collect()
    assert sorted(map(tuple, found)) == plain_top(rows, k)


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "MOST_QUERIES", 3)
    rows = odd_rows()
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(map(tuple, found)) == plain_top(rows, 5)


def test_top_k_keeps_large_components_and_repeated_ids(spark):
    rows = [(20, [1.0, 1.0]), (1, [300_000.0, 0.0]), (2, [5.0, 0.0]), (2, [9.0, 0.0]), (20, [-3.0, 2.0]), (3, [-1e9, 4.0]), (4, [2.5e13, -1.0])]
    rows = [(*r, 1, 2, 3, "x") for r in rows]
    found = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found)) == plain_top(rows, 20) and len(found) == 12
    for bad, text in (([1e15, 0.0], "component"), ([1e14, 0.0], "score")):
        with pytest.raises(Exception, match=f"{text} is too large"):
            topk.top_k(spark.createDataFrame([*rows, (5, bad, 1, 2, 3, "x"), (40, [1e13, 0.0], 1, 2, 3, "x")], SCHEMA), F.col("vec_id") % 20 == 0).collect()


def test_slices():
    rng = np.random.default_rng(1)
    for low, high, ties in ((-40, 40, 1), (0, 2, 1), (-3, -2, 1), (-5000, 70000, 50)):
        vectors = rng.integers(low, high, (130, 9)) // ties * ties
        block = topk.SlicedBlock(vectors)
        for q in (0, 64, 129):
            rows, scores = block.best(vectors[q], 20, q)
            plain = sorted((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q)[:20]
            assert sorted(zip((-scores).tolist(), rows.tolist())) == plain
    assert all(sum(s << p for p, s in topk.signed_digits(v)) == v for v in range(-300, 300))


def plain_links(rows, least):
    unit = {}
    for r in rows:
        v = r[1]
        if r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[r[0]] = (r[2], x / np.linalg.norm(x))
    linked = {a: {b for b, y in unit.items() if b != a and x[0] == y[0] and len(x[1]) == len(y[1]) and x[1] @ y[1] >= least} for a, x in unit.items()}
    component = {}
    for a in sorted(unit):
        if a not in component:
            todo = [a]
            while todo:
                b = todo.pop()
                if b not in component:
                    component[b] = a
                    todo += linked[b]
    return linked, component


def test_near_vectors(spark):
    rows = odd_rows()
    linked, component = plain_links(rows, 0.93)
    found = vector_dedup.dedup_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_links == len(linked.get(r.vec_id, ())), r
        assert r.component_id == component.get(r.vec_id, r.vec_id) and r.kept == (r.vec_id == r.component_id)
    assert vector_dedup.dedup_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_and_chunks(spark, monkeypatch):
    """A large group of near vectors, cut into chunks, and many small groups."""
    monkeypatch.setattr(vector_dedup, "CHUNK", 32)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 32))
    vectors = [centres[0] + 0.08 * rng.normal(size=32) for _ in range(150)]
    vectors += [c + s * rng.normal(size=32) for c in centres[1:] for s in (0.02, 0.1, 0.2, 0.3)]
    rows = [(k, [float(x) for x in v], 1, 0, 0, "") for k, v in enumerate(vectors)]
    linked, _ = plain_links(rows, 0.93)
    found = {r.vec_id: r.n_links for r in vector_dedup.dedup_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(found[k] <= len(linked[k]) for k in found)
    assert sum(found.values()) >= 0.97 * sum(map(len, linked.values()))


def test_best_filters():
    for dims, words, n in ((10, 16, 30), (9, 7, 100), (1, 2, 28), (64, 40, 28)):
        filters = vector_dedup.CapFilters(dims, words)
        unit = np.random.default_rng(3).normal(size=(50, dims))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        a, b = filters._halves(unit)
        sums = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
        found = filters.best(unit, n)
        assert found.shape == (50, min(n, words**2)) and all(len(set(x.tolist())) == len(x) for x in found)
        assert np.allclose(np.take_along_axis(sums, found, 1), -np.sort(-sums, axis=1)[:, :n])


@pytest.mark.parametrize("vectors", [10_256, 1_000_000, 10_000_000])
def test_recall_does_not_fall_with_size(vectors):
    """Random pairs just above the least cosine, under the filters of tables of different sizes."""
    rng, dims, cosine = np.random.default_rng(12), 64, 0.932
    x, y = rng.normal(size=(2, 500, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    met = [set() for _ in rows]
    filters, n = vector_dedup._filters(dims, vector_dedup.words_for(vectors, dims), 0.93)
    for k, v in rows:
        met[k].update(filters.best(np.array([v]), n)[0].tolist())
    assert min(map(len, met)) == n
    assert sum(not a.isdisjoint(b) for a, b in zip(met[:500], met[500:])) >= 0.99 * 500


def test_too_low_a_cosine_raises(monkeypatch):
    monkeypatch.setattr(vector_dedup, "MOST_FILTERS", 16)
    with pytest.raises(ValueError, match="more than 16 filters"):
        vector_dedup.CapFilters(48, 30).enough(0.2)
