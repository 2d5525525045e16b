"""Shared statistics: fused per-column aggregates, value frequencies, percentiles by sketch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkclean.audit import row_hash
from sparkclean.functions.missing import as_text, col, is_numeric

# Patterns of NULLs that are counted one by one.
MASKS = 10_000
# Values of a column that are counted once more at most, and smallest texts that are looked at first beyond that.
CANDIDATES, SMALLEST = 1_000, 64
# Smallest texts that are looked at before a column's texts are all counted instead.
MOST_SMALLEST = 50_000


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and NULLs per column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    row = df.agg(*aggs).first()
    return row["rows"], {c: row["rows"] - row[f"c{i}"] for i, c in enumerate(df.columns)}


def spelled(df: DataFrame, names: list[str]) -> DataFrame:
    """(col_pos, value) of every cell that isn't NULL, values as text, and two 64-bit hashes of the text."""
    types = {f.name: f.dataType for f in df.schema}
    cells = F.array(*[
        F.struct(F.lit(i).alias("col_pos"), as_text(c, types[c]).alias("value")) for i, c in enumerate(names)
    ])
    known = df.select(F.inline(cells)).where(F.col("value").isNotNull())
    return known.withColumns({"h": F.xxhash64("value"), "g": F.xxhash64(F.lit(1), "value")})


def hashed_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(col_pos, h, g, cnt) for every distinct value: one shuffle for all columns, of 128-bit hashes counted before it.

    No text is moved, and a value that fills a third of a column is one row a task.
    """
    return spelled(df, names).groupBy("col_pos", "h", "g").agg(F.count(F.lit(1)).alias("cnt"))


@dataclass(frozen=True)
class ValueSummary:
    """Distinct values of a column, their entropy, and how many of them have each of the highest counts."""

    distinct: int = 0
    entropy: float | None = None
    counts: tuple[tuple[int, int], ...] = ()


def value_summaries(df: DataFrame, names: list[str], k: int = 1) -> dict[str, ValueSummary]:
    """Summaries with the k highest counts, from the number of values that have each count: few rows however many values."""
    if not names:
        return {}
    own = hashed_counts(df, names).groupBy("col_pos", "cnt").agg(F.count(F.lit(1)).alias("m"))
    cnt, m = F.col("cnt"), F.col("m")
    total = F.sum(cnt * m)
    rows = own.groupBy("col_pos").agg(
        F.sum(m).alias("distinct"), F.round(F.abs(F.log2(total) - F.sum(m * cnt * F.log2(cnt)) / total), 4).alias("entropy"),
        # Counts differ, so a column of N cells has less than sqrt(2 * N) of them.
        F.slice(F.sort_array(F.collect_list(F.struct("cnt", "m")), asc=False), 1, k).alias("counts")).collect()
    found = {names[r["col_pos"]]: ValueSummary(r["distinct"], r["entropy"], tuple((c["cnt"], c["m"]) for c in r["counts"])) for r in rows}
    return {c: found.get(c, ValueSummary()) for c in names}


def _smallest(df: DataFrame, names: list[str], n: int) -> DataFrame:
    """(col_pos, value): the n smallest distinct texts of each column; every task sends n at most."""
    types = {f.name: f.dataType for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [pa.array([], pa.string())] * len(names)
        for batch in batches:
            for i in range(len(names)):
                own = pc.unique(pa.concat_arrays([kept[i], pc.drop_null(batch.column(i)).cast(pa.string())]))
                kept[i] = own.take(pc.array_sort_indices(own)[:n])
        for i, own in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int32()), own], ["col_pos", "value"])

    texts = df.select(*[as_text(c, types[c]).alias(f"t{i}") for i, c in enumerate(names)])
    least = texts.mapInArrow(run, "col_pos int, value string").distinct()
    order = Window.partitionBy("col_pos").orderBy("value")
    return least.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("col_pos", "value")


def top_counts(
    df: DataFrame, names: list[str], k: int, known: dict[str, ValueSummary] | None = None, first: int = SMALLEST,
) -> dict[str, list[tuple[str, int]]]:
    """The k most frequent values of each column as text, with their counts; equal counts by value.

    The summaries tell the lowest count that counts, so the hashes at or above it are the candidates and only their texts
    are counted once more. Where very many values share that lowest count, as in a column of unique texts, the smallest
    texts of the column are candidates instead, and more of them until enough have that count. If they stand so late in
    the order that MOST_SMALLEST don't reach them, the texts of that column alone are counted in a shuffle.
    """
    summaries = known or value_summaries(df, names, k)
    names = [c for c in names if summaries[c].distinct]
    if not names:
        return {}
    floor, above, many = {}, {}, []
    for c in names:
        total = 0
        for cnt, m in summaries[c].counts:
            floor[c], above[c] = cnt, total
            total += m
            if total >= k:
                break
        if total > max(CANDIDATES, k):
            many.append(c)
    # At most CANDIDATES hashes a column.
    limits = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(i), F.lit(floor[c] + (c in many)).cast("bigint"))])
    rows = hashed_counts(df, names).where(F.col("cnt") >= limits[F.col("col_pos")]).select("col_pos", "h", "g").collect()
    spark, out = df.sparkSession, {}
    wanted = spark.createDataFrame([tuple(r) for r in rows], "col_pos int, h long, g long")
    todo, n = list(names), first
    while todo:
        for c in [c for c in todo if c in many and n > MOST_SMALLEST]:
            counts = spelled(df, [c]).groupBy("value").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= floor[c])
            out[c] = [(r["value"], r["cnt"]) for r in counts.orderBy(F.desc("cnt"), "value").limit(k).collect()]
            todo.remove(c)
        if not todo:
            break
        tied = [c for c in todo if c in many]
        if tied:
            place = F.create_map(*[x for i, c in enumerate(tied) for x in (F.lit(i), F.lit(names.index(c)))])
            least = _smallest(df, tied, n).select(place[F.col("col_pos")].alias("col_pos"), F.xxhash64("value").alias("h"), F.xxhash64(F.lit(1), "value").alias("g"))
            wanted = wanted.union(spark.createDataFrame([tuple(r) for r in least.collect()], wanted.schema)).distinct()  # n a column
        cells = spelled(df, names).join(F.broadcast(wanted), ["col_pos", "h", "g"])
        counted: dict[str, list[tuple[str, int]]] = {c: [] for c in names}
        for r in cells.groupBy("col_pos", "value").agg(F.count(F.lit(1)).alias("cnt")).collect():
            counted[names[r["col_pos"]]].append((r["value"], r["cnt"]))
        for c in list(todo):
            own = sorted((x for x in counted[c] if x[1] >= floor[c]), key=lambda x: (-x[1], x[0]))
            if c not in many or len(own) >= k or n >= summaries[c].distinct:
                out[c] = own[:k]
                todo.remove(c)
        n *= 16
    return out


def null_masks(df: DataFrame, most: int = MASKS) -> dict[str, int] | None:
    """Rows for each pattern of NULLs, a text with 1 for each NULL cell; None if there are more than `most` patterns.

    One pass: the patterns tell how many rows, and NULLs of each column, are left after rows with a NULL in any other
    columns are dropped, in any order.
    """
    mask = F.concat(F.lit(""), *[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    found = df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    return {r["mask"]: r["n"] for r in found} if len(found) <= most else None


def left_after(masks: dict[str, int], names: list[str], dropped: list[str]) -> tuple[int, dict[str, int]]:
    """Row count and NULLs per column of the rows without a NULL in the `dropped` columns."""
    gone = [names.index(c) for c in dropped]
    left = {m: n for m, n in masks.items() if not any(m[i] == "1" for i in gone)}
    return sum(left.values()), {c: sum(n for m, n in left.items() if m[i] == "1") for i, c in enumerate(names)}


def modes(df: DataFrame, names: list[str]) -> dict[str, Any]:
    """Most frequent value of each column, the smallest on a tie; None for columns without values.

    One shuffle for all columns, on (column, value) after a map-side count, with every value in its own type: the built-in
    mode gathers all distinct values of a column in one task.
    """
    if not names:
        return {}
    types, own = {f.name: f.dataType for f in df.schema}, [f"v{i}" for i in range(len(names))]
    cells = [
        F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("col_pos"), *[
            (col(c) if j == i else F.lit(None).cast(types[names[j]])).alias(o) for j, o in enumerate(own)]))
        for i, c in enumerate(names)]
    spelled = df.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")
    counted = spelled.groupBy("col_pos", *own).agg(F.count(F.lit(1)).alias("cnt"))
    best = counted.groupBy("col_pos").agg(F.min_by(F.struct(*own), F.struct((-F.col("cnt")).alias("n"), *own)).alias("best"))
    found = {r["col_pos"]: r["best"][r["col_pos"]] for r in best.collect()}
    return {c: found.get(i) for i, c in enumerate(names)}


def duplicate_rows(df: DataFrame) -> tuple[int, int]:
    """Row count, and rows beyond the first of each group of equal rows (NULL equals NULL).

    Rows are counted by a 128-bit hash first, so only 16 bytes per row are shuffled, after a map-side count. If no hash
    repeats there are no duplicates, which is so for any table with a key. Otherwise the rows whose hash repeats, and
    only those, are grouped by their values, with the copies counted before the shuffle.
    """
    one, other = row_hash(df), row_hash(df, 1)
    hashed = df.select(one.alias("h"), other.alias("g")).groupBy("h", "g").agg(F.count(F.lit(1)).alias("cnt"))
    repeats = F.col("cnt") > 1
    seen = hashed.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(repeats, F.col("cnt"))), F.lit(0)).alias("repeated")).first()
    if not seen["repeated"]:
        return seen["rows"], 0
    types = {f.name: f.dataType for f in df.schema}
    keys = [
        (F.to_json(col(c)) if isinstance(types[c], T.MapType) else col(c)).alias(f"k{i}")
        for i, c in enumerate(df.columns)
    ]
    rows = df.select(*keys, one.alias("h"), other.alias("g")).join(hashed.where(repeats).select("h", "g"), ["h", "g"], "left_semi")
    return seen["rows"], seen["repeated"] - rows.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.lit(1)).count()


def approx_percentiles(df: DataFrame, probs: dict[str, list[float]], accuracy: int) -> dict[str, list[float | None]]:
    names = list(probs)
    if not names:
        return {}
    row = df.agg(*[
        F.percentile_approx(col(c).cast("double"), probs[c], accuracy).alias(f"p{i}") for i, c in enumerate(names)
    ]).first()
    return {c: list(row[f"p{i}"]) if row[f"p{i}"] is not None else [None] * len(probs[c])
            for i, c in enumerate(names)}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]
