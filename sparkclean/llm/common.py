"""Small helpers the operators share: Arrow batches in bounded slices, written tables, block counts."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkclean.sources.scratch import drop_written, written

__all__ = ["SLICE_BYTES", "byte_slices", "drop_written", "label_components", "mapped", "ragged", "shuffle_parts", "texts_of", "utf8_views", "written"]

SLICE_BYTES = 4 << 20


def _released() -> None:
    """Give memory that a task no longer needs back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """`df.mapInArrow(run, schema)` whose tasks leave no free memory behind in their worker."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _released()

    return df.mapInArrow(whole, schema)


def _utf8(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds about `limit` bytes a slice; a longer single value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.frombuffer(_utf8(batch.column(column)).buffers()[1], np.int64)[1 : batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def utf8_views(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    binary = _utf8(batch.column(column).fill_null(""))
    binary = pa.concat_arrays([binary])
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def label_components(links: DataFrame, src: str = "a", dst: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest node id reachable from each node of an undirected link table: columns node, component.

    Alternating large-star and small-star steps, each an aggregation over links written to the shared folder. The number
    of steps grows with the logarithm of the longest chain. Empty input gives an empty table; loops and repeated links
    have no effect. Raises if `rounds` steps do not settle, instead of returning unfinished components.
    """
    pairs = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    edges = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        before, edges = edges, written(small, "links")
        drop_written(before)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))
