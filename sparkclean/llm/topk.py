"""Exact top-k search by integer inner product over a bit-sliced index.

A block of rows keeps, for each component, one bitmap a binary digit. The scores of all rows of a block for a query come
from adding those bitmaps, shifted by the digits of the query's components, with full adders; the result is again one
bitmap a digit, from which the best rows are taken from the most significant slice downward.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkclean.llm.common import parts_for, written

#: Rows of an index block; least and most queries that meet it in one task, and meetings wanted for each core.
ROWS, QUERIES, MOST_QUERIES, MEETINGS = 65_536, 256, 16_384, 4
#: Quantised components from this size on raise an error: their scores are far beyond a long.
TOO_LARGE = 1 << 55


def signed_digits(value: int) -> list[tuple[int, int]]:
    """Non-adjacent form: (place, +1 or -1) with sum of sign * 2^place equal to `value`."""
    out, place = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((place, sign))
            value -= sign
        value >>= 1
        place += 1
    return out


class SlicedBlock:
    """Bitmaps of the digits of every component, from its least value on, and their complements."""

    def __init__(self, vectors: np.ndarray):
        rows, self.dims = vectors.shape
        self.rows = rows
        padded = np.zeros((-(-rows // 64) * 64, self.dims), np.int64)
        self.low = vectors.min(axis=0) if rows else np.zeros(self.dims, np.int64)
        padded[:rows] = vectors - self.low
        top = padded.max(axis=0) if rows else np.zeros(self.dims, np.int64)
        self.digits = [int(t).bit_length() for t in top]
        self.slices = [
            [np.ascontiguousarray(np.packbits((padded[:, d] >> b) & 1, bitorder="little")).view(np.uint64) for b in range(n)]
            for d, n in enumerate(self.digits)]
        self.inverse = [[~x for x in own] for own in self.slices]
        present = np.zeros(len(padded), np.uint8)
        present[:rows] = 1
        self.present = np.packbits(present, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of all rows' scores, least significant first, and what is to be added to each."""
        by_weight: dict[int, list[np.ndarray]] = defaultdict(list)
        base = sum(a * b for a, b in zip(query.tolist(), self.low.tolist()))
        for d, value in enumerate(query.tolist()):
            for place, sign in signed_digits(value):
                # minus u is the complement of u, minus (2^digits - 1)
                for b, own in enumerate(self.slices[d] if sign > 0 else self.inverse[d]):
                    by_weight[place + b].append(own)
                if sign < 0:
                    base -= ((1 << self.digits[d]) - 1) << place
        out, weight = [], 0
        while weight <= max(by_weight, default=-1):
            own = by_weight[weight]
            while len(own) > 2:
                a, b, c = own.pop(), own.pop(), own.pop()
                half = a ^ b
                own.append(half ^ c)
                half &= c
                half |= a & b
                by_weight[weight + 1].append(half)
            if len(own) == 2:
                a, b = own
                by_weight[weight + 1].append(a & b)
                own = [a ^ b]
            out.append(own[0] if own else np.zeros_like(self.present))
            weight += 1
        return out, base

    def best(self, query: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k highest scores, ties to the smaller row number, and these scores. `skip` is left out."""
        slices, base = self.scores(query)
        open_rows, sure = self.present.copy(), np.zeros_like(self.present)
        if skip is not None:
            open_rows[skip >> 6] &= ~np.uint64(1 << (skip & 63))
        wanted = k
        for own in reversed(slices):
            upper = open_rows & own
            n = int(np.bitwise_count(upper).sum())
            if n >= wanted:
                open_rows = upper
            else:
                sure |= upper
                wanted -= n
                open_rows &= ~own
        rows = np.concatenate([_places(sure), _places(open_rows)[:wanted]])  # those still open have the boundary score
        bits = [(own[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1) for own in slices]
        kind = np.int64 if len(slices) < 62 and abs(base) < 1 << 62 else object  # Python's integers hold any sum
        return rows, base + sum((b.astype(kind) << w for w, b in enumerate(bits)), np.zeros(len(rows), kind))


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """row, id and floor(scale * x) of every vector that can take part."""
    x = F.col(vector_col)
    able = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v: Column) -> Column:
        scaled = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double")) * scale < TOO_LARGE, scaled).otherwise(F.raise_error(F.lit("a component is too large for scores in a long")).cast("long"))

    rows = df.where(F.col(id_col).isNotNull() & x.isNotNull() & able)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _packed(vectors: np.ndarray) -> bytes:
    """Rows of whole numbers, four bytes each where they fit."""
    small = not vectors.size or max(-int(vectors.min()), int(vectors.max())) < 1 << 31
    return vectors.astype(np.int32 if small else np.int64).tobytes()


def _unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = np.int64 if len(data) == 8 * rows * dims else np.int32
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, dims)


def _blocks(rows: DataFrame, size: int, parts: int, number: str) -> DataFrame:
    """Rows gathered into blocks of one dimension, by id: row numbers, ids and vectors, as binary. One column scan, no groups."""
    names = [number, "dims", "rows", "ids", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), defaultdict(list)

        def block(dims: int) -> pa.RecordBatch:
            numbers, ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dims)))
            order = np.lexsort((numbers, ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([dims], pa.int32()), pa.array([numbers[order].tobytes()], pa.binary()),
                 pa.array([ids[order].tobytes()], pa.binary()), pa.array([_packed(vectors[order])], pa.binary())], names)

        for batch in batches:
            numbers, ids, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            flat, starts = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                held[dims].append((numbers[mine], ids[mine], flat[starts[mine][:, None] + np.arange(dims)].reshape(len(mine), dims)))
                if sum(len(x) for x, _, _ in held[dims]) >= size:
                    yield block(dims)
        for dims in list(held):
            yield block(dims)

    schema = f"{number} int, dims int, rows binary, ids binary, vectors binary"
    return written(rows.repartition(parts).mapInArrow(run, schema), "topk-blocks")


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other rows, ties to the smaller id.

    Components become floor(scale * x) of x as double. `is_query` is a condition on `id_col`. Returns query_id long, rank
    int from 1, `id_col` long, score long. A vector takes no part if it or its id is null, or if it holds a null or a
    value that isn't finite. Every other row is a candidate of its own, and a query of its own if its id is one: rows that
    repeat an id are candidates of each other. Vectors are compared with those of the same number of components. With
    fewer than k other rows, all are returned; an empty table gives no rows. Other columns are not read. Sums are exact
    whatever their size; a returned score beyond a long raises an error, and so does a component of 2^55 or more.
    """
    rows = written(quantised(df, id_col, vector_col, scale), "topk-rows")
    queries = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    n_r, wanted = parts_for(rows.count(), ROWS), queries.count()
    meetings = MEETINGS * df.sparkSession.sparkContext.defaultParallelism
    size = min(max(QUERIES, wanted * n_r // meetings), MOST_QUERIES)  # more would copy the index less often, fewer use more cores
    n_q = parts_for(wanted, size)
    index, asked = _blocks(rows, ROWS, n_r, "r"), _blocks(queries, size, n_q, "q")
    # Every query block meets every index block, each pair under a key of its own.
    left = index.select("dims", "rows", "ids", "vectors", "r", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"))
    right = asked.select("dims", *[F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "vectors")], "q", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("r"))
    columns = ["dims", "rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, own_rows, ids, vectors, q_rows, q_ids, q_vectors in zip(*(batch.column(n).to_pylist() for n in columns)):
                own_rows, ids, q_rows, q_ids = (np.frombuffer(x, np.int64) for x in (own_rows, ids, q_rows, q_ids))
                block, queried = SlicedBlock(_unpacked(vectors, len(ids), dims)), _unpacked(q_vectors, len(q_ids), dims)
                order = np.argsort(own_rows)
                at = order[np.minimum(np.searchsorted(own_rows, q_rows, sorter=order), len(order) - 1)]
                found = [block.best(query, k, place if own_rows[place] == row else None) for query, place, row in zip(queried, at.tolist(), q_rows.tolist())]
                sizes = [len(x) for x, _ in found]
                scores = pa.array([Decimal(int(s)) for _, own in found for s in own], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_rows, sizes)), pa.array(np.repeat(q_ids, sizes)), pa.array(ids[np.concatenate([x for x, _ in found])]), scores],
                    ["row", "query_id", id_col, "score"])

    near = left.join(right, ["r", "q", "dims"]).select(columns).mapInArrow(run, f"row long, query_id long, `{id_col}` long, score decimal(38,0)")
    order = Window.partitionBy("row").orderBy(F.desc("score"), id_col)
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.col("score").between(-(1 << 63), (1 << 63) - 1)
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score is too large for a long")).cast("long"))
    return best.select("query_id", "rank", id_col, score.alias("score"))
