"""Join with a lookup table, with key checks and match statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.audit import Lineage, StepLog, StepResult
from sparkclean.functions.missing import col, is_numeric, is_time, nan_to_null
from sparkclean.functions.names import free_name, free_prefix

JOIN_TYPES = ("left", "right", "inner", "outer")
# Match rate that brings a warning, and the confidence above a match rate.
FEW_MATCHES = 0.5
CONFIDENCE = ((0.9, 1.0), (0.5, 0.75), (-1.0, 0.5))
# The rows of a key with more rows than this on one side are dealt to several tasks, and those of a key with more pairs of rows than HOT_KEY_PAIRS,
# of which CELL_PAIRS meet at once: an outer join holds all output rows of one key.
HOT_KEY_ROWS = 1_000_000
HOT_KEY_PAIRS, CELL_PAIRS = 200_000, 16_384
# The list of such keys is broadcast: at most so many, and so many bytes.
MAX_HOT_KEYS, HOT_KEY_BYTES = 100_000, 8 << 20


@dataclass
class MergeResult(StepResult):
    match_rate: float
    left_unmatched: int
    right_unmatched: int
    left_duplicates: int
    right_duplicates: int
    columns_added: list[str]


def _check_key(left: DataFrame, right: DataFrame, key: str, how: str) -> None:
    if how not in JOIN_TYPES:
        raise ValueError(f"join_type is one of {', '.join(JOIN_TYPES)}, not {how!r}")
    for side, df in (("primary", left), ("secondary", right)):
        if key not in df.columns:
            raise ValueError(f"the {side} table has no column {key!r}, only {df.columns}")
    kinds = [_kind(df.schema[key].dataType) for df in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"{key!r} is {left.schema[key].dataType.simpleString()} in one table and "
                         f"{right.schema[key].dataType.simpleString()} in the other; they can't be compared")


def _kind(dtype: T.DataType) -> str:
    return "number" if is_numeric(dtype) else "time" if is_time(dtype) else dtype.simpleString()


def key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_count, right_count): one row per key of either side, NULL being one key.

    Reads the key column only. The counts are made before the shuffle, so a key that holds a third of a
    table reaches it as one row per task, and the join is between unique keys.
    """
    sides = []
    for name, df in (("l", left), ("r", right)):
        sides.append(df.groupBy(col(key).alias(f"{name}_key")).agg(F.count(F.lit(1)).alias(f"{name}_count")))
    joined = sides[0].join(sides[1], F.col("l_key").eqNullSafe(F.col("r_key")), "full")
    return joined.select(
        F.coalesce("l_key", "r_key").alias("key"),
        F.coalesce("l_count", F.lit(0)).alias("left_count"),
        F.coalesce("r_count", F.lit(0)).alias("right_count"),
    )


def _statistics(counts: DataFrame) -> DataFrame:
    left, right = F.col("left_count") > 0, F.col("right_count") > 0
    known = F.col("key").isNotNull()
    return counts.agg(
        F.coalesce(F.sum("left_count"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("right_count"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.col("left_count") * F.col("right_count")), F.lit(0)).alias("inner_rows"),
        F.coalesce(F.sum(F.when(~right, F.col("left_count"))), F.lit(0)).alias("left_only_rows"),
        F.coalesce(F.sum(F.when(~left, F.col("right_count"))), F.lit(0)).alias("right_only_rows"),
        F.coalesce(F.sum(F.greatest(F.col("left_count") - 1, F.lit(0))), F.lit(0)).alias("left_duplicates"),
        F.coalesce(F.sum(F.greatest(F.col("right_count") - 1, F.lit(0))), F.lit(0)).alias("right_duplicates"),
        F.coalesce(F.max(F.greatest("left_count", "right_count")), F.lit(0)).alias("max_count"),
        F.coalesce(F.max(F.col("left_count") * F.col("right_count")), F.lit(0)).alias("max_pairs"),
        F.count_if(known & left).alias("left_keys"),
        F.count_if(known & left & right).alias("matched"),
        F.count_if(known & left & ~right).alias("left_unmatched"),
        F.count_if(known & ~left & right).alias("right_unmatched"),
    )


def match_stats(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Matched and unmatched distinct non-null keys, and the share of left keys that match."""
    _check_key(left, right, key, "inner")
    s = _statistics(key_counts(nan_to_null(left), nan_to_null(right), key))
    return s.select(
        "matched", "left_unmatched", "right_unmatched",
        F.round(F.col("matched") / F.greatest("left_keys", F.lit(1)), 4).alias("match_rate"))


def join_key_duplicates(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key value, on each side; NULL counts as a value."""
    _check_key(left, right, key, "inner")
    return _statistics(key_counts(nan_to_null(left), nan_to_null(right), key)).select(
        "left_duplicates", "right_duplicates")


def _registered(left: DataFrame, name: str) -> DataFrame:
    spark = left.sparkSession
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table is registered as {name!r}")
    return spark.table(name)


def merge_datasets(
    left: DataFrame,
    right: DataFrame | str,
    join_key: str,
    join_type: str = "left",
    validate_key_uniqueness: bool = True,
    secondary_name: str | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> MergeResult:
    """Equi-join on one column. NULL keys match NULL keys; colliding right columns get `_right`.

    `right` is a table or the name of a registered secondary dataset. The key counts needed for the statistics also show the hot keys and the exact output size.
    """
    if isinstance(right, str):
        right, secondary_name = _registered(left, right), secondary_name or right
    _check_key(left, right, join_key, join_type)
    left, right = nan_to_null(left), nan_to_null(right)
    right, added = _without_collisions(left, right, join_key)

    counts = key_counts(left, right, join_key)
    s = _statistics(counts).first()
    hot = _hot_keys(counts, hot_key_rows) if s["max_count"] > hot_key_rows or s["max_pairs"] > HOT_KEY_PAIRS else []
    if hot:
        joined = _join_salted(left, right, join_key, join_type, hot, counts.schema["key"].dataType, hot_key_rows)
    else:
        joined = _join(left, right, join_key, join_type)

    match_rate = s["matched"] / max(s["left_keys"], 1)
    warnings = []
    if validate_key_uniqueness:
        for side, n in (("primary", s["left_duplicates"]), ("secondary", s["right_duplicates"])):
            if n:
                warnings.append(f"{n} rows of the {side} table repeat a value of {join_key!r}.")
    if match_rate < FEW_MATCHES:
        warnings.append(f"Few matches: {match_rate * 100:.1f}% of the primary keys of {join_key!r} have a partner.")
    rows_after = s["inner_rows"]
    rows_after += s["left_only_rows"] if join_type in ("left", "outer") else 0
    rows_after += s["right_only_rows"] if join_type in ("right", "outer") else 0
    confidence = next(value for above, value in CONFIDENCE if match_rate > above)
    log = StepLog(
        "merge_datasets", len(left.columns), len(joined.columns), confidence, s["left_rows"], rows_after,
        column_lineage=Lineage(columns_added=added),
        detail={"secondary_name": secondary_name, "join_key": join_key, "join_type": join_type,
                "match_rate": round(match_rate, 4), "left_unmatched": s["left_unmatched"],
                "right_unmatched": s["right_unmatched"]},
        warnings=warnings,
    )
    return MergeResult(joined, log, round(match_rate, 4), s["left_unmatched"], s["right_unmatched"],
                       s["left_duplicates"], s["right_duplicates"], added)


def _without_collisions(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    taken = set(left.columns) | set(right.columns)
    lower_left = {c.lower() for c in left.columns}
    names = []
    for c in right.columns:
        new = c
        if c != key and c.lower() in lower_left:
            new = free_name(f"{c}_right", taken)
            taken.add(new)
        names.append(new)
    return right.toDF(*names), [c for c in names if c != key]


def _join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """One output key column, filled from whichever side has the row."""
    other = free_name("_right_key", {*left.columns, *right.columns})
    l, r = left.alias("l"), right.withColumnRenamed(key, other).alias("r")
    joined = l.join(r, col(key).eqNullSafe(col(other)), how)
    merged = [F.coalesce(col(c), col(other)).alias(c) if c == key else col(c) for c in left.columns]
    return joined.select(*merged, *[col(c) for c in right.columns if c != key])


def _hot_keys(counts: DataFrame, limit: int) -> list:
    """Keys of more than `limit` rows on a side or HOT_KEY_PAIRS pairs, the most of these first: at most MAX_HOT_KEYS, and HOT_KEY_BYTES of their text."""
    pairs = F.col("left_count") * F.col("right_count")
    rows = F.greatest("left_count", "right_count", pairs)
    hot = (F.greatest("left_count", "right_count") > limit) | (pairs > HOT_KEY_PAIRS)
    size = F.coalesce(F.octet_length(F.col("key").cast("string")), F.lit(0)) + 32
    listed = counts.where(hot).select("*", rows.alias("rows"), size.alias("size")).orderBy(F.desc("rows"), "key").limit(MAX_HOT_KEYS)
    room, out = HOT_KEY_BYTES, []
    for r in listed.where(F.col("size") <= HOT_KEY_BYTES // 16).collect():
        room -= r["size"]
        if room < 0:
            break
        out.append(r)
    return out


def _chunks(left_count: int, right_count: int, limit: int) -> tuple[int, int]:
    """Into how many chunks each side's rows of a key are dealt: no chunk above `limit` rows, no two chunks above CELL_PAIRS pairs."""
    across, down = -(-left_count // limit), -(-right_count // limit)
    if left_count * right_count <= HOT_KEY_PAIRS:
        return max(across, 1), max(down, 1)
    # Square cells copy the least; a side with fewer rows than the edge stays whole.
    edge = math.isqrt(CELL_PAIRS)
    wide, high = min(left_count, edge), min(right_count, edge)
    wide, high = max(wide, CELL_PAIRS // high), max(high, CELL_PAIRS // wide)
    return max(across, -(-left_count // wide)), max(down, -(-right_count // high))


def _join_salted(left, right, key, how, hot, key_type, limit) -> DataFrame:
    """One join on the key and a salt, so that the rows of a hot key are not shuffled to one task.

    A key that is hot: each side's rows are dealt into chunks, and every chunk of one side meets every chunk of the other in a
    cell of its own. Copies that meet an empty chunk are taken out again; each row has partners in some chunk, so none is
    lost. A key that only one side has is dealt out without copies. All other rows have salt 0. Equal rows fall into
    different chunks: rows are numbered after a sort by their hash, so a task that runs again deals out the same. Each side
    is read once; the map of hot keys has a bounded size.
    """
    spark, own = left.sparkSession, free_prefix("_merge", [*left.columns, *right.columns])
    schema = T.StructType([
        T.StructField(f"{own}hot", key_type), T.StructField(f"{own}both", T.BooleanType()),
        T.StructField(f"{own}across", T.LongType()), T.StructField(f"{own}down", T.LongType())])
    listed = F.broadcast(spark.createDataFrame([
        (r["key"], r["left_count"] > 0 and r["right_count"] > 0, *_chunks(r["left_count"], r["right_count"], limit)) for r in hot], schema))
    across, down, both, number = (F.col(f"{own}{c}") for c in ("across", "down", "both", "number"))

    def dealt(df: DataFrame, is_left: bool) -> DataFrame:
        row = F.xxhash64(*[F.to_json(col(f.name)) if isinstance(f.dataType, T.MapType) else col(f.name) for f in df.schema])
        marked = df.join(listed, col(key).eqNullSafe(F.col(f"{own}hot")), "left")
        # Sorted by the hot rows' hash only: the others need no number.
        marked = marked.sortWithinPartitions(F.when(both.isNotNull(), row)).withColumn(f"{own}number", F.xxhash64(F.monotonically_increasing_id()))
        one = F.lit(0).cast("bigint")
        if is_left:
            chunk = F.pmod(number, across) * down
            salts = F.transform(F.sequence(one, down - 1), lambda i: chunk + i)
        else:
            chunk = F.pmod(number, down)
            salts = F.transform(F.sequence(one, across - 1), lambda i: chunk + i * down)
        salts = F.when(both.isNull(), F.array(one)).otherwise(salts)
        return marked.select(*map(col, df.columns), F.coalesce(both, F.lit(False)).alias(f"{own}both"), F.explode(salts).alias(f"{own}salt"))

    other = {key: f"{own}key", f"{own}both": f"{own}both_too", f"{own}salt": f"{own}at"}
    l, r = dealt(left, True), dealt(right, False).withColumnsRenamed(other)
    met = l.join(r, col(key).eqNullSafe(F.col(f"{own}key")) & (F.col(f"{own}salt") == F.col(f"{own}at")), how)
    alone = F.col(f"{own}salt").isNull() | F.col(f"{own}at").isNull()
    met = met.where(~(alone & (F.coalesce(f"{own}both", F.lit(False)) | F.coalesce(f"{own}both_too", F.lit(False)))))
    merged = [F.coalesce(col(c), F.col(f"{own}key")).alias(c) if c == key else col(c) for c in left.columns]
    return met.select(*merged, *[col(c) for c in right.columns if c != key])
