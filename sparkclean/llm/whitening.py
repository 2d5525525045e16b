"""Whitening by an incremental eigendecomposition: centred rank-one updates, merged spectra, Rayleigh-Ritz refinement.

Each task keeps the spectrum of the scatter matrix of what it has read and updates it by one direction after the other. The
eigenvalues of a diagonal matrix plus a rank-one term are the roots of a secular equation, one between each two old ones,
once entries that can't move theirs are deflated. Many vectors are first turned into as many directions as they have
dimensions: the triangular factor of the centred vectors has the same scatter as they have. Spectra of tasks are combined by updating one with each eigenpair of the other, in a
tree of groups of bounded size. A last pass over all rows forms the Rayleigh quotient in the basis found.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclean.llm.common import written

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: States combined by one task, steps for the roots of a secular equation, and vectors a dimension that are turned at once.
GROUP, STEPS, TURNED = 16, 100, 32
#: Eigenvalues below this share of the trace are rounding, not variance.
FLAT = 1e-12
EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w / (d - x)) for rising d and positive w, as values and as the matrix of root i less pole j.

    Root i lies between poles i and i + 1, the last one within sum(w) of the last pole. Each is sought as the distance to
    its nearer pole, by the rational function through both neighbours, halving the bracket where that leads out of it.
    """
    k = len(d)
    gap = np.append(np.diff(d), w.sum())
    middle = d + gap / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        right = 1 + (w / (d - middle[:, None])).sum(axis=1) < 0
        right[-1] = False
        origin = np.where(right, np.append(d[1:], 0), d)
        poles = d - origin[:, None]
        low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
        high[-1] = gap[-1]
        x, left = (low + high) / 2, np.tril(np.ones((k, k), bool))
        at, after = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
        todo = np.arange(k)
        for _ in range(STEPS):
            away = poles[todo] - x[todo, None]
            term = w / away
            f = 1 + term.sum(axis=1)
            slope = term / away
            up, down = np.where(f < 0, x[todo], low[todo]), np.where(f < 0, high[todo], x[todo])
            low[todo], high[todo] = up, down
            done = (np.abs(f) <= EPS * (1 + np.abs(term).sum(axis=1))) | (down - up <= 2 * EPS * np.maximum(np.abs(up), np.abs(down)))
            if done.all():
                break
            before = (slope * left[todo]).sum(axis=1)
            behind = slope.sum(axis=1) - before
            p, q = away[np.arange(len(todo)), at[todo]], away[np.arange(len(todo)), after[todo]]
            c = f - p * before - q * behind
            a, b = (p + q) * f - p * q * (before + behind), p * q * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            last = todo == k - 1
            if last.any():
                one = f[last] - p[last] * before[last]
                step[last] = p[last] + before[last] * p[last] ** 2 / one
            new = x[todo] + step
            inside = (new > up) & (new < down)
            x[todo] = np.where(done, x[todo], np.where(inside, new, (up + down) / 2))
            todo = todo[~done]
    return origin + x, x[:, None] - poles


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors (columns) after adding weight * direction direction^T.

    Deflated are entries of the direction too small to move an eigenvalue, and equal eigenvalues: a reflection of their
    eigenvectors leaves one with the direction's whole share.
    """
    size = float(direction @ direction) * weight
    if not size > 0:
        return values, vectors
    z = vectors.T @ direction
    least = 8 * EPS * max(np.abs(values).max(), size)
    cuts = np.flatnonzero(np.diff(values, prepend=-np.inf) > least)
    sizes = np.diff(cuts, append=len(values))
    if (sizes > 1).any():
        vectors = vectors.copy()
        for begin, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = z[begin : begin + n].copy()
            norm = np.linalg.norm(own)
            if norm > 0:
                mirror = own.copy()
                mirror[-1] += np.copysign(norm, own[-1])
                mirror /= np.linalg.norm(mirror)
                part = vectors[:, begin : begin + n]
                vectors[:, begin : begin + n] = part - 2 * np.outer(part @ mirror, mirror)
                z[begin : begin + n] = 0
                z[begin + n - 1] = -np.copysign(norm, own[-1])
    active = np.flatnonzero(weight * np.abs(z) * np.sqrt(size / weight) > least)
    if not len(active):
        return values, vectors
    d, own = values[active], z[active]
    roots, less = secular_roots(d, weight * own**2)
    # The direction that has exactly these roots, so that its eigenvectors are orthogonal.
    k = len(d)
    between = np.where(np.arange(k)[:, None] < np.arange(k), d[:, None], np.append(d[1:], 0)[:, None]) - d
    between[-1] = weight
    exact = np.copysign(np.sqrt(np.abs(np.prod(less / between, axis=0))), own)
    turn = exact[:, None] / -less.T
    turn /= np.linalg.norm(turn, axis=0)
    values, vectors = values.copy(), vectors.copy()
    values[active], vectors[:, active] = roots, vectors[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, exact sums, mean, and the eigenvalues and eigenvectors of the scatter around the mean of vectors."""

    def __init__(self, dims: int):
        self.n, self.sums, self.mean = 0, [0] * dims, np.zeros(dims)
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """Rows of integers, by centred rank-one updates."""
        self.sums = [a + b for a, b in zip(self.sums, exact_sums(x))]
        size = max(TURNED * x.shape[1], 1)
        for start in range(0, len(x), size):
            rows = x[start : start + size].astype(np.float64)
            if len(rows) > 2 * x.shape[1]:
                mean = rows.mean(axis=0)
                for direction in np.linalg.qr(rows - mean, mode="r"):
                    self._shifted(direction, 1.0)
                self._joined(mean, len(rows))
            else:
                for row in rows:
                    self._joined(row, 1)

    def _joined(self, mean: np.ndarray, n: int) -> None:
        """Count in n vectors of the given mean, whose scatter around it is already here."""
        away = mean - self.mean
        self._shifted(away, self.n * n / (self.n + n))
        self.mean = self.mean + away * (n / (self.n + n))
        self.n += n

    def _shifted(self, direction: np.ndarray, weight: float) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, direction, weight)

    def merge(self, other: Spectrum) -> Spectrum:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._shifted(vector, float(value))
        self._joined(other.mean, other.n)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        return self


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns as Python integers: of the high and the low 32 bits apart."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(a) << 32) + int(b) for a, b in zip(high, low)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(x - sums / n) as double, and the exact sum over each row of (n * x - sums)^2."""
    own = np.array(sums, object)
    nearest = np.array([s // n for s in sums], object)
    spread = max((abs(int(v) - int(m)) for extreme in (x.min(axis=0), x.max(axis=0)) for v, m in zip(extreme, nearest)), default=0) + 1
    if spread * n < 1 << 31 and x.shape[1] < 1 << 20 and len(sums) * (spread * n) ** 2 < 1 << 63:
        away = (x - nearest.astype(np.int64)) * n - (own - nearest * n).astype(np.int64)
        return away / n, (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - own
    return (away / n).astype(np.float64), [int(s) for s in (away * away).sum(axis=1)]


def integers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of all vectors of a batch, a row each."""
    lists = batch.column(column)
    sizes = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries can't be whitened together")
    scaled = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("an entry of a vector is too large for a long")
    return scaled.astype(np.int64).reshape(batch.num_rows, -1) + OFFSET


def folded(rows: DataFrame, of_batches: Callable[[Iterator[pa.RecordBatch]], object | None], merge: Callable[[object, object], object]):
    """One state of all rows: `of_batches` makes a task's state or None, `merge` combines two, GROUP of them a task and round."""
    spark: SparkSession = rows.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = of_batches(batches)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], ["k", "state"])

    def combined(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        state = reduce(merge, (pickle.loads(x) for x in table.column("state").to_pylist()))
        return pa.table({"k": pa.array([table.column("g")[0].as_py()], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    states = written(rows.mapInArrow(first, "k long, state binary"), "whitening-states")
    most = states.agg(F.max("k")).first()[0]
    while most:  # numbers 0 to most
        states = states.withColumn("g", F.floor(F.col("k") / GROUP)).groupBy("g").applyInArrow(combined, "k long, state binary")
        states, most = written(states, "whitening-states"), most // GROUP
    row = states.select("state").first()
    return None if row is None else pickle.loads(row["state"])


def _spectrum(batches: Iterator[pa.RecordBatch]) -> Spectrum | None:
    out = None
    for batch in batches:
        if batch.num_rows:
            x = integers(batch, "v")
            out = out or Spectrum(x.shape[1])
            if x.shape[1] != len(out.sums):
                raise ValueError(f"vectors of {len(out.sums)} and of {x.shape[1]} entries can't be whitened together")
            out.add(x)
    return out


def _merged(a: Spectrum, b: Spectrum) -> Spectrum:
    if len(a.sums) != len(b.sums):
        raise ValueError(f"vectors of {len(a.sums)} and of {len(b.sums)} entries can't be whitened together")
    return a.merge(b)


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every vector: `id_col`, component int (from 1), n, deviation (long), whitened, explained, identity_error (double).

    Entries c become x = floor(1024 * c) + 100000 of c as double. All rows with a vector without nulls and values that
    aren't finite are the fit list and are returned, those with a null id and repeated ones too; others take no part. A
    component is a unit eigenvector of the covariance of x (divisor n), in falling order of eigenvalues, to double
    precision. deviation is the exact sum of (n * x - sum of x)^2; it raises ArithmeticError if that is beyond a long.
    explained is the eigenvalue by the trace. identity_error is the largest absolute entry of the covariance of all
    whitened values less the identity. A component without variance (constant dimensions, fewer rows than components) has
    whitened null and explained 0 and doesn't count in identity_error, which is null if no component has any. An empty
    table, or vectors without entries, give no rows. Vectors of different lengths, and entries beyond 2^52, raise
    ValueError. Other columns are not read.

    The last pass works in the basis of all eigenvectors, so it removes the rounding of the updates whatever the gaps
    between eigenvalues. States have the size of a covariance matrix; nothing else reaches the driver.
    """
    x = F.col(vector_col)
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), x.alias("v")).where(sound)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found: Spectrum | None = folded(rows.select("v"), _spectrum, _merged)
    if found is None or not found.sums:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, basis = found.n, found.sums, found.vectors

    def quotient(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                turned = deviations(integers(batch, "v"), n, sums)[0] @ basis
                total = turned.T @ turned + (0 if total is None else total)
        return total

    values, turn = np.linalg.eigh(folded(rows.select("v"), quotient, np.add) / n)
    trace, order = float(values.sum()), np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], basis @ turn[:, order]
    varied = values > FLAT * trace
    share = np.where(varied, values / trace, 0.0) if trace > 0 else np.zeros(len(values))
    scaled = vectors / np.sqrt(np.where(varied, values, 1.0))

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = deviations(integers(batch, "v"), n, sums)[0] @ scaled
                y = np.column_stack([np.ones(len(y)), y])
                total = y.T @ y + (0 if total is None else total)
        return total

    both = folded(rows.select("v"), moments, np.add) / n
    covariance = both[1:, 1:] - np.outer(both[0, 1:], both[0, 1:])
    error = np.abs(covariance - np.eye(len(values)))[np.ix_(varied, varied)]
    identity_error = float(error.max()) if error.size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                away, deviation = deviations(integers(batch, "v"), n, sums)
                if max(deviation, default=0) >= 1 << 63:
                    raise ArithmeticError("a deviation is too large for a long")
                k, rows_of = len(values), np.repeat(np.arange(batch.num_rows), len(values))
                total = len(rows_of)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(total, n)), pa.array(deviation, pa.int64()).take(pa.array(rows_of)),
                    pa.array((away @ scaled).ravel(), mask=np.tile(~varied, batch.num_rows)), pa.array(np.tile(share, batch.num_rows)),
                    pa.array([identity_error] * total, pa.float64())], names)

    return rows.mapInArrow(run, schema)
