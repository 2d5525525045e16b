"""Missing-value handling: drop sparse columns, then fill or drop per column."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from math import ceil
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkclean.audit import Lineage, StepLog, StepResult
from sparkclean.functions.missing import col, is_numeric, is_time, nan_to_null
from sparkclean.functions.names import free_prefix
from sparkclean.operators import stats
from sparkclean.operators.percentiles import percentile_values
from sparkclean.sources.scratch import written

STRATEGIES = ("mean", "median", "mode", "ffill", "bfill", "drop_row", "constant")
# A window holds one partition key in one task; above this many rows the work of a key is split.
MAX_GROUP_ROWS = 1_000_000
# Ranges whose carried values one task puts in order.
SCAN_WIDTH = 1_000


@dataclass
class ImputeResult(StepResult):
    columns_imputed: dict[str, str] = field(default_factory=dict)
    columns_dropped: list[str] = field(default_factory=list)
    cells_targeted: dict[str, int] = field(default_factory=dict)
    fill_values: dict[str, Any] = field(default_factory=dict)


def drop_sparse_columns(df: DataFrame, drop_threshold: float = 0.5) -> DataFrame:
    """Drop every column whose missing share is above the threshold."""
    df = nan_to_null(df)
    rows, nulls = stats.null_counts(df)
    return df.drop(*_sparse(rows, nulls, drop_threshold))


def _sparse(rows: int, nulls: dict[str, int], threshold: float) -> list[str]:
    return [c for c, n in nulls.items() if rows and n / rows > threshold]


def handle_missing_values(
    df: DataFrame,
    strategy_config: dict[str, str],
    constant_fill_values: dict[str, Any] | None = None,
    drop_threshold: float = 0.5,
    order_by: str | list[str] | None = None,
    partition_by: str | list[str] | None = None,
    accuracy: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> ImputeResult:
    """Apply the strategies in the order of the dict.

    `drop_row` is a barrier: what follows sees only the remaining rows. All fills between two barriers
    share one statistics pass and one projection. `order_by` gives the row order that ffill and bfill need
    (rows of equal values follow a hash of the row), `partition_by` keeps fills within groups. `accuracy` switches the median to a
    sketch. A threshold of 1 or more never drops a column.
    """
    if drop_threshold < 0:
        raise ValueError("drop_threshold must not be negative")
    constants = constant_fill_values or {}
    order, keys = _as_list(order_by), _as_list(partition_by)
    _check_columns(df, order + keys)
    df = nan_to_null(df)
    cols_before = len(df.columns)
    masks, names = stats.null_masks(df), df.columns
    rows, nulls = stats.left_after(masks, names, []) if masks is not None else stats.null_counts(df)
    rows_before, warnings = rows, []

    dropped = _sparse(rows, nulls, drop_threshold)
    for c in dropped:
        warnings.append(
            f"'{c}' was removed: {nulls[c]} of {rows} cells are empty, more than the allowed share of {drop_threshold:g}.")
    if set(dropped) & set(order + keys):
        raise ValueError(f"order_by or partition_by column is too sparse: {dropped}")
    out = df.drop(*dropped)

    result = ImputeResult(out, StepLog("handle_missing_values", cols_before, 0, 0.95), columns_dropped=dropped)
    steps = _checked(out, strategy_config, constants, order, warnings)
    segment: dict[str, str] = {}
    cleared: list[str] = []  # columns whose NULLs took their rows along
    counted = 0  # of these, those that `nulls` knows of
    for c, strategy in steps.items():
        if counted < len(cleared):
            rows, nulls = stats.left_after(masks, names, cleared) if masks is not None else stats.null_counts(out)
            counted = len(cleared)
        if not nulls[c]:
            continue
        result.cells_targeted[c], result.columns_imputed[c] = nulls[c], strategy
        if strategy != "drop_row":
            segment[c] = strategy
            continue
        out = _fill(out, segment, constants, rows, order, keys, accuracy, max_group_rows, result)
        segment = {}
        out = out.where(col(c).isNotNull())
        rows -= nulls[c]
        cleared.append(c)
    out = _fill(out, segment, constants, rows, order, keys, accuracy, max_group_rows, result)

    before, after = dict(df.dtypes), dict(out.dtypes)
    changed = {c: (before[c], after[c]) for c in after if before[c] != after[c]}
    result.df = out
    log = result.log
    log.cols_after, log.rows_before, log.rows_after = len(out.columns), rows_before, rows
    log.cells_modified = sum(result.cells_targeted.values())
    log.column_lineage = Lineage(columns_removed=dropped, type_changes=changed)
    log.detail = {"columns_imputed": result.columns_imputed, "columns_dropped": dropped,
                  "drop_threshold": drop_threshold}
    log.warnings = warnings
    return result


def _as_list(names: str | list[str] | None) -> list[str]:
    return [names] if isinstance(names, str) else list(names or [])


def _check_columns(df: DataFrame, names: list[str]) -> None:
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"columns not found: {unknown}")


def _checked(df: DataFrame, config: dict[str, str], constants: dict[str, Any], order: list[str],
             warnings: list[str]) -> dict[str, str]:
    """Strategies that can run; the rest become warnings. Wrong types raise before any job starts."""
    types = {f.name: f.dataType for f in df.schema}
    steps = {}
    for c, strategy in config.items():
        if c not in types:
            warnings.append(f"There is no column '{c}' (any more), so its strategy has no effect.")
        elif strategy not in STRATEGIES:
            warnings.append(f"'{c}' keeps its gaps: no strategy is called '{strategy}'.")
        elif strategy == "constant" and c not in constants:
            warnings.append(f"'{c}' keeps its gaps: constant_fill_values has no value for it.")
        else:
            if strategy in ("mean", "median") and not (is_numeric(types[c]) or is_time(types[c])):
                raise ValueError(f"strategy={strategy} needs a numeric or time column; '{c}' is {types[c].simpleString()}")
            if strategy in ("ffill", "bfill") and not order:
                raise ValueError(f"strategy={strategy} for '{c}' needs order_by: a table has no row order in Spark")
            if strategy == "constant" and not _literal_fits(constants[c], types[c]):
                raise ValueError(f"constant {constants[c]!r} does not fit column '{c}' of type {types[c].simpleString()}")
            steps[c] = strategy
    return steps


def _literal_fits(value: Any, dtype: T.DataType) -> bool:
    if isinstance(dtype, T.BooleanType):
        return isinstance(value, bool)
    if is_numeric(dtype):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if is_time(dtype):
        return isinstance(value, (dt.date, dt.datetime))
    return isinstance(dtype, T.StringType) and isinstance(value, str)


def _fill(df, segment, constants, rows, order, keys, accuracy, max_group_rows, result) -> DataFrame:
    if not segment:
        return df
    values = fill_values(df, {c: s for c, s in segment.items() if s in ("mean", "median", "mode")}, accuracy)
    values.update({c: constants[c] for c, s in segment.items() if s == "constant"})
    result.fill_values.update(values)
    types = {f.name: f.dataType for f in df.schema}
    df = df.withColumns({c: _filled(c, types[c], v) for c, v in values.items() if v is not None})
    directed = {c: s for c, s in segment.items() if s in ("ffill", "bfill")}
    return fill_directional(df, directed, order, keys, rows, max_group_rows) if directed else df


class EpochMicros(int):
    """A time as microseconds since 1970 in the session's zone, whatever the zone of the driver."""


def _filled(name: str, dtype: T.DataType, value: Any):
    if isinstance(value, EpochMicros):
        return F.coalesce(col(name), F.timestamp_micros(F.lit(int(value))).cast(dtype))
    whole = isinstance(dtype, T.IntegralType)
    if whole and isinstance(value, float) and not value.is_integer():
        return F.coalesce(col(name).cast("double"), F.lit(value))
    return F.coalesce(col(name), F.lit(value).cast(dtype))


def fill_values(df: DataFrame, strategies: dict[str, str], accuracy: int | None = None) -> dict[str, Any]:
    """Mean, median or mode per column; None where a column has no value. Means of times are EpochMicros."""
    types = {f.name: f.dataType for f in df.schema}
    out: dict[str, Any] = {}

    def number(c):
        return F.unix_micros(col(c).cast("timestamp")) if is_time(types[c]) else col(c)

    measured = [c for c, s in strategies.items() if s in ("mean", "median")]
    numbers = df.select(*[number(c).alias(c) for c in measured])
    means = [c for c in measured if strategies[c] == "mean"]
    if means:
        row = numbers.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(means)]).first()
        out.update({c: row[f"m{i}"] for i, c in enumerate(means)})
    medians = {c: [0.5] for c in measured if strategies[c] == "median"}
    if medians:
        found = (percentile_values(numbers, medians) if accuracy is None
                 else stats.approx_percentiles(numbers, medians, accuracy))
        out.update({c: v[0] for c, v in found.items()})
    for c in measured:
        if is_time(types[c]) and out[c] is not None:
            out[c] = EpochMicros(out[c])
    out.update(stats.modes(df, [c for c, s in strategies.items() if s == "mode"]))
    return out


def fill_directional(
    df: DataFrame, strategies: dict[str, str], order_by: list[str], partition_by: list[str],
    rows: int | None = None, max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Carry the last (ffill) or next (bfill) value over NULLs in the order of `order_by`.

    Groups of a checked, moderate size run in an ordinary window. Otherwise the table is cut into ranges
    of the order columns, each range is filled by itself, and the value to carry into a range comes from
    a table with one row per group and range. No task then holds more than one range, however large a
    group is.
    """
    columns, own = df.columns, free_prefix("_fill", df.columns)
    # Rows of equal order values are ordered by a hash of the row, so the answer doesn't depend on the scheme.
    cells = [F.to_json(col(f.name)) if isinstance(f.dataType, T.MapType) else col(f.name) for f in df.schema]
    df = df.withColumn(f"{own}tie", F.xxhash64(*cells))
    order_by = [*order_by, f"{own}tie"]
    rows = df.count() if rows is None else rows
    biggest = rows
    if partition_by:
        biggest = df.groupBy(*map(col, partition_by)).count().agg(F.max("count")).first()[0] or 0
    if biggest <= max_group_rows:
        return df.withColumns({c: _window_fill(c, s, partition_by, order_by) for c, s in strategies.items()}).select(*map(col, columns))

    ranges = max(ceil(rows / max(max_group_rows, 1)), 2) if max_group_rows else 8
    ranged = written(
        df.repartitionByRange(ranges, *map(col, order_by)).withColumn(f"{own}range", F.spark_partition_id()), "fill-ranges")
    place = F.struct(*map(col, order_by))
    carries = []
    for i, (c, s) in enumerate(strategies.items()):
        pick = F.max_by if s == "ffill" else F.min_by
        carries.append(pick(col(c), F.when(col(c).isNotNull(), place)).alias(f"{own}edge{i}"))
    keys = [f"{own}key{i}" for i in range(len(partition_by))]
    edges = ranged.groupBy(*[col(c).alias(k) for c, k in zip(partition_by, keys)], F.col(f"{own}range").alias(f"{own}at")).agg(*carries)
    carry = _scanned(written(edges, "fill-edges"), ranges, keys, list(strategies.values()), own)
    match = F.col(f"{own}range") == F.col(f"{own}at")
    for i, c in enumerate(partition_by):
        match &= col(c).eqNullSafe(F.col(f"{own}key{i}"))
    joined = ranged.join(carry, match, "left")
    inner = [*partition_by, f"{own}range"]
    filled = joined.withColumns({
        c: F.coalesce(_window_fill(c, s, inner, order_by), F.col(f"{own}carry{i}"))
        for i, (c, s) in enumerate(strategies.items())
    })
    return filled.select(*map(col, columns))


def _scanned(edges: DataFrame, ranges: int, keys: list[str], strategies: list[str], own: str) -> DataFrame:
    """keys, `at`, and what is carried into each range: a prefix scan of the ranges' edges on several levels.

    Ranges are taken in groups of SCAN_WIDTH; a group's own edges carry within it, and what is carried into a group comes from
    the same scan over the groups, until one group is left. So no task orders more rows of a key than that.
    """
    at, group = f"{own}at", f"{own}group"
    n = range(len(strategies))
    placed = edges.withColumn(group, F.floor(F.col(at) / SCAN_WIDTH).cast("int"))
    within = Window.partitionBy(*keys, group).orderBy(at)
    earlier, later = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(1, Window.unboundedFollowing)
    near = placed.select(*keys, at, group, *[
        (F.last(f"{own}edge{i}", ignorenulls=True).over(earlier) if s == "ffill" else F.first(f"{own}edge{i}", ignorenulls=True).over(later)).alias(f"{own}carry{i}")
        for i, s in enumerate(strategies)])
    groups = ceil(ranges / SCAN_WIDTH)
    if groups <= 1:
        return near.drop(group)
    ends = [(F.max_by if s == "ffill" else F.min_by)(f"{own}edge{i}", F.when(F.col(f"{own}edge{i}").isNotNull(), F.col(at))).alias(f"{own}edge{i}")
            for i, s in enumerate(strategies)]
    above = _scanned(written(placed.groupBy(*keys, F.col(group).alias(f"{own}up")).agg(*ends).withColumnRenamed(f"{own}up", at), "fill-edges"), groups, keys, strategies, own)
    above = above.select(*[F.col(k).alias(f"{k}_up") for k in keys], F.col(at).alias(f"{own}up"), *[F.col(f"{own}carry{i}").alias(f"{own}far{i}") for i in n])
    match = reduce(lambda m, k: m & F.col(k).eqNullSafe(F.col(f"{k}_up")), keys, F.col(group) == F.col(f"{own}up"))
    return near.join(above, match, "left").select(*keys, at, *[F.coalesce(f"{own}carry{i}", f"{own}far{i}").alias(f"{own}carry{i}") for i in n])


def _window_fill(name: str, strategy: str, partition_by: list[str], order_by: list[str]):
    window = Window.partitionBy(*map(col, partition_by)).orderBy(*map(col, order_by))
    if strategy == "ffill":
        return F.last(col(name), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return F.first(col(name), ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))


def impute_report(result: ImputeResult) -> DataFrame:
    """Per column: strategy, cells that were missing, and cells that were really filled or removed."""
    _, nulls_after = stats.null_counts(result.df)
    out = [
        (c, s, result.cells_targeted[c], nulls_after[c], result.cells_targeted[c] - nulls_after[c])
        for c, s in result.columns_imputed.items()
    ]
    schema = "name string, strategy string, cells_targeted long, nulls_after long, cells_modified long"
    return result.df.sparkSession.createDataFrame(out, schema)
