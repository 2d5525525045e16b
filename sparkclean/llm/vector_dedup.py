"""Near-duplicate vectors by spherical-cap filters: structured random product codes, list decoding, verification.

A filter is a direction put together from two code words, one for each half of the rotated vector. Every vector stands
under all filters whose inner product exceeds its own threshold, that of its n-th best filter; list decoding finds them
without looking at each filter. A threshold common to all vectors would need several times as many filters for the same
recall, since it leaves some vectors under none and puts others under hundreds. n follows from the number of code words,
so that near vectors share a filter with the wanted probability at any size of the table. Pairs under one filter are
verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclean.llm.common import label_components, written
from sparkclean.llm.shingle_join import spanning

#: Vectors for each filter. Fewer make smaller cells, and more filters and so more copies of a vector.
VECTORS_PER_FILTER = 96
#: Share of random pairs exactly at the least cosine that are to meet under a filter, pairs it is measured with, and the
#: number of filters of a vector beyond which an error tells that the cosine is too low for this search.
RECALL, PROBES, MOST_FILTERS = 0.998, 4000, 4096
#: Vectors of a chunk; larger sets under one filter are compared chunk by chunk, two a task.
CHUNK = 1024
SEED = 7


class CapFilters:
    """`words` code words for each half, so words^2 filters, in `dims` dimensions."""

    def __init__(self, dims: int, words: int):
        rng = np.random.default_rng([SEED, dims, words])
        self.half = dims // 2
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        self.words = [self._unit(rng, words, n) for n in (self.half, dims - self.half)]
        self.dims = dims

    @staticmethod
    def _unit(rng: np.random.Generator, words: int, dims: int) -> np.ndarray:
        one = rng.standard_normal((-(-words // 2), dims))
        one /= np.maximum(np.linalg.norm(one, axis=1, keepdims=True), 1e-12)
        return np.concatenate([one, -one])[:words]

    def _halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        return turned[:, : self.half] @ self.words[0].T, turned[:, self.half :] @ self.words[1].T

    def best(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n best filters of each vector, or all if they are fewer, best first."""
        words, rows = len(self.words[0]), max(1, (1 << 18) // len(self.words[0]))
        n, few = min(n, words**2), min(n, words)
        # A filter of the i-th and the j-th best word has i * j - 1 others that are at least as good.
        i, j = np.divmod(np.arange(few * few), few)
        able = (i + 1) * (j + 1) <= n
        i, j = i[able], j[able]

        def leading(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.argpartition(x, words - few, axis=1)[:, words - few :]
            at = np.take_along_axis(at, np.argsort(-np.take_along_axis(x, at, 1), axis=1, kind="stable"), 1)
            return at, np.take_along_axis(x, at, 1)

        out = np.zeros((len(unit), n), np.int64)
        for start in range(0, len(unit), rows):
            a, b = self._halves(unit[start : start + rows])
            (first, x), (second, y) = leading(a), leading(b)
            falling = np.argsort(-(x[:, i] + y[:, j]), axis=1, kind="stable")[:, :n]
            out[start : start + rows] = np.take_along_axis(first, i[falling], 1) * words + np.take_along_axis(second, j[falling], 1)
        return out

    def enough(self, least: float) -> int:
        """Filters for each vector so that the share RECALL of pairs at the cosine `least` has one in common."""
        every = len(self.words[0]) ** 2
        if every == 1 or self.dims < 2:
            return every
        rng, cosine = np.random.default_rng([SEED, self.dims]), min(max(least, -1.0), 1.0)
        x, y = rng.standard_normal((2, PROBES, self.dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y *= np.sqrt(1 - cosine * cosine) / np.linalg.norm(y, axis=1, keepdims=True)
        n = 4
        while True:
            n = min(2 * n, every)
            if n > MOST_FILTERS:
                raise ValueError(f"pairs of cosine {least} need more than {MOST_FILTERS} filters of {every} to meet")
            needed = np.full(PROBES, every)
            for k, (p, q) in enumerate(zip(self.best(x, n), self.best(cosine * x + y, n))):
                common, at, other = np.intersect1d(p, q, assume_unique=True, return_indices=True)
                if len(common):
                    needed[k] = np.maximum(at, other).min() + 1
            wanted = int(np.quantile(needed, RECALL, method="higher"))
            if wanted <= n or n == every:
                return min(wanted, every)


@lru_cache(8)
def _filters(dims: int, words: int, least: float) -> tuple[CapFilters, int]:
    """Filters, and under how many of them a vector stands."""
    filters = CapFilters(dims, words)
    return filters, filters.enough(least)


def words_for(vectors: int, dims: int) -> int:
    """Code words a half: VECTORS_PER_FILTER vectors a filter, no more filters than make sense in few dimensions."""
    return int(max(2, min(np.ceil(np.sqrt(max(vectors, 8192) / VECTORS_PER_FILTER)), 2 ** min(dims, 20))))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column as double, and the numbers of values."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.float64), np.diff(offsets)


def _filtered(vectors: DataFrame, total: int, least: float) -> DataFrame:
    """Every vector with the list of its filters, ascending."""
    names = ["node", "label", "copies", "v", "dims", "filters"]
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                flat, sizes = _matrix(batch.column("v"))
                begins = np.cumsum(sizes) - sizes
                for dims in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dims)
                    unit = flat[begins[rows][:, None] + np.arange(dims)]
                    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    filters, n = _filters(dims, words_for(total, dims), least)
                    own = np.sort(filters.best(unit, n), axis=1)
                    lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.ravel()))
                    columns = [batch.column(n).take(pa.array(rows)) for n in names[:4]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rows), dims, np.int32)), lists], names)

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select(*names[:4]).mapInArrow(run, f"node long, label {label}, copies long, v {kind}, dims int, filters array<long>")


def cell_links(unit: np.ndarray, copies: np.ndarray, slots: np.ndarray, lists: list[np.ndarray], this: int, least: float):
    """Weights of the links of each vector of a cell, and links that connect the same vectors.

    A pair counts under the first filter that both stand under. Between chunks, only pairs of different slots count.
    """
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if slots[0] != slots[-1]:
        linked &= slots[:, None] != slots[None, :]
    if not linked.any():
        return np.zeros(len(unit), np.int64), []
    earlier = [x[: np.searchsorted(x, this)] for x in lists]
    names = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(names[0]):
        stands = np.zeros((len(unit), len(names[0])), np.float32)
        stands[np.repeat(np.arange(len(unit)), [len(x) for x in earlier]), names[1].ravel()] = 1
        linked &= stands @ stands.T == 0
    return linked @ copies, spanning(linked)


def _links(filtered: DataFrame, least: float) -> DataFrame:
    """Rows a, b null, n: n more links of a; and rows a, b, 0: a link."""
    key = ["label", "dims", "filter"]
    each = filtered.select("*", F.explode("filters").alias("filter"))
    counts = each.groupBy(*key).count().where("count > 1")
    rows = each.join(counts, key).withColumn("chunks", F.ceil(F.col("count") / CHUNK))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("node"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cell = F.xxhash64("label", "dims", "filter", F.least("slot", "other"), F.greatest("slot", "other"))
    rows = rows.select(cell.alias("cell"), "slot", "filter", "node", "copies", "v", "filters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            column = {n: table.column(n).chunk(0) for n in table.column_names}
            flat, sizes = _matrix(column["v"])
            unit = flat.reshape(len(sizes), -1)
            unit = unit / np.abs(unit).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            values, lengths = column["filters"].flatten().to_numpy(), np.diff(column["filters"].offsets.to_numpy())
            lists = np.split(values, np.cumsum(lengths)[:-1])
            nodes = column["node"].to_numpy()
            weights, edges = cell_links(unit, column["copies"].to_numpy(), column["slot"].to_numpy(), lists, int(column["filter"][0].as_py()), least)
            some = np.flatnonzero(weights)
            edges = np.array(edges, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([nodes[some], nodes[edges[:, 0]]])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[edges[:, 1]])]),
                 pa.array(np.concatenate([weights[some], np.zeros(len(edges), np.int64)]))], ["a", "b", "n"])

        open_cell, parts = None, []
        for batch in batches:  # sorted by cell
            cells = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for x, y in zip(cuts, cuts[1:]):
                if parts and cells[x] != open_cell:
                    yield compared(parts)
                    parts = []
                open_cell = cells[x]
                parts.append(batch.slice(x, y - x))
        if parts:
            yield compared(parts)

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "slot", "node")
    return dealt.mapInArrow(run, "a long, b long, n long")


def dedup_vectors(df: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: `id_col`, n_links long, component_id, kept boolean (its id is the component's smallest).

    Vectors of equal, not null labels and equal numbers of components link when their cosine in double precision is at
    least `least`; links are found with high probability (RECALL at `least` itself, more above) and none below is taken. Raises
    ValueError where that needs more than MOST_FILTERS filters a vector, as for low cosines. A vector that is null, zero or holds
    null or non-finite components links with nothing, nor does one with a null id. n_links counts other ids: rows that
    repeat an id and vector count once, and copies under other ids count each. Every input row gives one row; an empty
    table gives none. Other columns are not read.
    """
    x = F.col(vector_col)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    able = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & sound, F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(able, x).alias("v"), able.alias("able"))
    rows = rows.withColumn("node", F.when(F.col("able"), F.xxhash64("label", "v")))
    one = rows.where("able").groupBy("node", "label", "v").agg(F.countDistinct("id").alias("copies"), F.min("id").alias("least_id"))
    vectors = written(one, "cap-vectors")
    found = written(_links(written(_filtered(vectors, vectors.count(), least), "cap-lists"), least), "cap-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = label_components(found.where("b is not null").select("a", "b"))
    nodes = vectors.select("node", "copies", "least_id").join(counts, "node", "left").join(comp, "node", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    nodes = nodes.join(smallest, "component").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(nodes, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
