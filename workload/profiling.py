"""Queries of the profile and quality operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclean.functions.missing import col
from sparkclean.operators import profile as P
from sparkclean.operators import quality as Q
from sparkclean.operators.percentiles import percentile_table
from workload.tables import dirty, dirty_sql, table

ORDERS = [
    # column, Spark type, logical type
    ("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "datetime"), ("o_orderpriority", "string", "categorical"),
]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
EVENT_TEXTS = ["event_type", "props"]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _rounded(df, names, digits=4):
    return df.withColumns({c: F.round(col(c), digits) for c in names})


def _strategy(kind: str) -> str:
    fill = {"numeric": "median", "datetime": "ffill"}.get(kind, "mode")
    return f"CASE WHEN missing_pct = 0 THEN NULL WHEN missing_pct > 50 THEN 'drop_row' ELSE '{fill}' END"


def _profile_columns_sql() -> str:
    parts = []
    for i, (c, dtype, kind) in enumerate(ORDERS):
        parts.append(f"""
            SELECT position, name, dtype_raw, inferred_type, missing_count, missing_pct, unique_count, unique_pct,
                   {_strategy(kind)} AS recommended_strategy
            FROM (SELECT CAST({i} AS INTEGER) AS position, '{c}' AS name, '{dtype}' AS dtype_raw,
                         '{kind}' AS inferred_type, count(*) - count({c}) AS missing_count,
                         round(100.0 * (count(*) - count({c})) / greatest(count(*), 1), 4) AS missing_pct,
                         count(DISTINCT {c}) AS unique_count,
                         round(100.0 * count(DISTINCT {c}) / greatest(count(*), 1), 4) AS unique_pct
                  FROM {dirty_sql('dirty_orders')} t)""")
    return _union(parts)


def profile_columns(spark, sf):
    found = P.profile_columns(dirty(spark, sf, "dirty_orders"))
    return found.select("position", "name", "dtype_raw", "inferred_type", "missing_count", "missing_pct",
                        "unique_count", "unique_pct", "recommended_strategy")


def profile_dataset(spark, sf):
    return P.profile_dataset(dirty(spark, sf, "line_shapes"))


PROFILE_DATASET_SQL = f"""
    WITH t AS (SELECT * FROM {dirty_sql('line_shapes')} x),

    s AS (SELECT (SELECT count(*) FROM t) AS row_count, (SELECT coalesce(sum(n - 1), 0) FROM
                 (SELECT count(*) AS n FROM t GROUP BY l_quantity, l_discount, l_returnflag, l_linestatus)) AS dups,
                 (SELECT 4 * count(*) - count(l_quantity) - count(l_discount) - count(l_returnflag)
                         - count(l_linestatus) FROM t) AS nulls),
    p AS (SELECT row_count, dups, round(100.0 * nulls / (4 * row_count), 4) AS miss,
                 round(100.0 * dups / row_count, 4) AS dup_pct FROM s)
    SELECT row_count, CAST(4 AS INTEGER) AS col_count, miss AS total_missing_pct,
           CAST(dups AS BIGINT) AS duplicate_count, dup_pct AS duplicate_pct,
           round(greatest(0, 100 - 0.5 * miss - 0.3 * dup_pct), 2) AS quality_score_estimate
    FROM p"""


def missingness_overview(spark, sf):
    return P.missingness_overview(dirty(spark, sf, "dirty_events"))


MISSINGNESS_SQL = _union([
    f"""SELECT '{c}' AS name, count(*) - count({c}) AS missing_count,
               round(100.0 * (count(*) - count({c})) / count(*), 1) AS missing_pct
        FROM {dirty_sql('dirty_events')} t HAVING count(*) > count({c})"""
    for c in ("event_id", "ts", "user_id", "value", "event_type", "props")
])


def duplicate_count(spark, sf):
    return P.duplicate_count(dirty(spark, sf, "line_shapes"))


DUPLICATE_SQL = f"""
    SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_count,
           round(100.0 * sum(n - 1) / sum(n), 4) AS duplicate_pct
    FROM (SELECT count(*) AS n FROM {dirty_sql('line_shapes')} t
          GROUP BY l_quantity, l_discount, l_returnflag, l_linestatus)"""


BIG = ["o_orderkey * 3 + 9007199254740993 AS big", "CAST(o_totalprice AS DECIMAL(20, 2)) * 1000003 AS amount"]


def percentiles_own_type(spark, sf):
    """Integers beyond 2^53 and wide decimals keep every digit."""
    return percentile_table(table(spark, sf, "orders").selectExpr(*BIG), {c: [0.1, 0.5, 0.99] for c in ("big", "amount")})


_RANKED = " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {c}) - 1 AS k, count(*) OVER () - 1 AS m FROM b" for c in ("big", "amount"))
PERCENTILES_SQL = f"""
    WITH b AS (SELECT {', '.join(BIG)} FROM orders), r AS ({_RANKED}),
    w AS (SELECT name, p, max(v) FILTER (k = floor(p * m)) AS lower, max(v) FILTER (k = ceil(p * m)) AS upper
          FROM r CROSS JOIN (SELECT unnest([0.1, 0.5, 0.99])::DOUBLE AS p) GROUP BY name, p)
    SELECT * FROM w"""


def numeric_stats(spark, sf):
    found = P.numeric_stats(dirty(spark, sf, "dirty_orders"))
    return _rounded(found, ["mean", "median", "std", "min", "max", "q25", "q75"], 2)


NUMERIC_SQL = _union([
    f"""SELECT '{c}' AS name, round(avg({c}), 2) AS mean, round(quantile_cont({c}, 0.5), 2) AS median,
               round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min,
               round(CAST(max({c}) AS DOUBLE), 2) AS max, round(quantile_cont({c}, 0.25), 2) AS q25,
               round(quantile_cont({c}, 0.75), 2) AS q75
        FROM {dirty_sql('dirty_orders')} t""" for c in ORDER_NUMBERS
])


def top_values(spark, sf):
    return P.top_values(dirty(spark, sf, "dirty_events"), EVENT_TEXTS)


TOP_SQL = _union([
    f"""SELECT '{c}' AS name, CAST(rk AS INTEGER) AS rank, v AS value, n AS count
        FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rk
              FROM {dirty_sql('dirty_events')} t WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rk <= 10"""
    for c in EVENT_TEXTS
])


def entropy(spark, sf):
    return P.entropy(dirty(spark, sf, "dirty_events"), EVENT_TEXTS)


ENTROPY_SQL = _union([
    f"""SELECT '{c}' AS name, round(entropy({c}), 4) AS entropy FROM {dirty_sql('dirty_events')} t
        WHERE {c} IS NOT NULL""" for c in EVENT_TEXTS
])


def datetime_stats(spark, sf):
    """A real timestamp column, one with times of day, and dates as text."""
    orders = table(spark, sf, "orders").select(
        "o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_text"), "o_orderstatus")
    events = table(spark, sf, "events").select("ts")
    return P.datetime_stats(orders).union(P.datetime_stats(events))


DATETIME_SQL = """
    SELECT 'o_orderdate' AS name, strftime(min(o_orderdate), '%Y-%m-%d') AS min_date,
           strftime(max(o_orderdate), '%Y-%m-%d') AS max_date, '%Y-%m-%d' AS inferred_format FROM orders
    UNION ALL
    SELECT 'order_text', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'), '%Y-%m-%d'
    FROM orders
    UNION ALL
    SELECT 'ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S'), strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'
    FROM events"""


def infer_logical_type(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_text"),
        (F.col("o_totalprice") > 200000).alias("is_large"), "o_orderdate",
        F.format_string("Order#%09d", "o_orderkey").alias("order_name"))
    return P.infer_logical_type(orders)


LOGICAL_SQL = """
    WITH t AS (SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS order_text,
                      printf('Order#%09d', o_orderkey) AS order_name FROM orders)
    SELECT 'o_orderkey' AS name, 'numeric' AS inferred_type
    UNION ALL SELECT 'is_large', 'boolean'
    UNION ALL SELECT 'o_orderdate', 'datetime'
    UNION ALL SELECT 'order_text', CASE WHEN count(try_strptime(order_text, '%Y-%m-%d')) = count(order_text)
              THEN 'datetime' ELSE 'text' END FROM t
    UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) / count(*) > 0.9 THEN 'text'
              ELSE 'categorical' END FROM t
    UNION ALL SELECT 'order_name', CASE WHEN count(DISTINCT order_name) / count(*) > 0.9 THEN 'text'
              ELSE 'categorical' END FROM t"""

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def iqr_outliers(spark, sf):
    found = P.iqr_outliers(table(spark, sf, "lineitem").select(*LINE_NUMBERS).union(
        table(spark, sf, "events").select(*["value"] * 4)))
    return _rounded(found, ["q25", "q75", "lower_bound", "upper_bound"])


OUTLIER_SQL = _union([
    f"""SELECT '{c}' AS name, round(q1, 4) AS q25, round(q3, 4) AS q75,
               round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
               count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))
                   AS outlier_count,
               round(100.0 * count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))
                     / count(*), 2) AS outlier_pct
        FROM (SELECT {c} FROM lineitem UNION ALL SELECT value FROM events) t,
             (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3
              FROM (SELECT {c} FROM lineitem UNION ALL SELECT value FROM events)) q
        GROUP BY q1, q3""" for c in LINE_NUMBERS
])


def flag_outliers(spark, sf):
    return P.flag_outliers(table(spark, sf, "events").select("event_id", "value"), "value")


FLAG_SQL = """
    SELECT event_id, value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier
    FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q"""


def column_anomalies(spark, sf):
    return P.column_anomalies(dirty(spark, sf, "line_constant"))


_LINE_COLUMNS = ("l_quantity", "l_tax", "l_returnflag", "state")


def _line_missing(c: str) -> str:
    """Rows, NULLs and their share, and distinct values of one column."""
    return f"""(SELECT count(*) AS n, count(*) - count({c}) AS miss, count(DISTINCT {c}) AS uniq,
                       round(100.0 * (count(*) - count({c})) / count(*), 4) AS pct
                FROM {dirty_sql('line_constant')} t)"""


ANOMALY_SQL = _union([
    *[f"""SELECT '{c}' AS name, 'high_missingness' AS anomaly_type,
                 printf('%.1f', pct) || '% of the cells are empty' AS description, miss AS affected_count,
                 round(pct, 2) AS affected_pct FROM {_line_missing(c)} WHERE pct > 20""" for c in _LINE_COLUMNS],
    *[f"""SELECT '{c}', 'constant_column', 'all cells hold the same value, or none', n, CAST(100 AS DOUBLE)
          FROM {_line_missing(c)} WHERE uniq <= 1 AND n > 1""" for c in _LINE_COLUMNS],
    *[f"""SELECT '{c}', 'possible_outliers', k || ' values lie outside the quartile fences', k,
                 round(100.0 * k / n, 2)
          FROM (SELECT count(*) AS n, count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1)
                       OR {c} > q3 + 1.5 * (q3 - q1))) AS k
                FROM {dirty_sql('line_constant')} t, (SELECT quantile_cont({c}, 0.25) AS q1,
                     quantile_cont({c}, 0.75) AS q3 FROM {dirty_sql('line_constant')} u) q) WHERE k > 0"""
      for c in ("l_quantity", "l_tax")],
])


def describe_all(spark, sf):
    found = P.describe_all(dirty(spark, sf, "dirty_orders"))
    return _rounded(found, ["mean", "std", "min", "q25", "q50", "q75", "max"], 2)


def _describe_sql() -> str:
    parts = []
    for c, _, kind in ORDERS:
        source = dirty_sql("dirty_orders")
        none = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in ("mean", "std", "min", "q25", "q50", "q75", "max"))
        top = "CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq"
        dates = "CAST(NULL AS VARCHAR) AS first_date, CAST(NULL AS VARCHAR) AS last_date"
        if kind == "numeric":
            none = (f"round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, "
                    f"round(CAST(min({c}) AS DOUBLE), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS q25, "
                    f"round(quantile_cont({c}, 0.5), 2) AS q50, round(quantile_cont({c}, 0.75), 2) AS q75, "
                    f"round(CAST(max({c}) AS DOUBLE), 2) AS max")
        elif kind == "datetime":
            dates = (f"strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS first_date, "
                     f"strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS last_date")
        else:
            best = (f"FROM (SELECT {c} AS v, count(*) AS n FROM {source} b WHERE {c} IS NOT NULL GROUP BY {c} "
                    f"ORDER BY n DESC, v LIMIT 1)")
            top = f"count(DISTINCT {c}) AS unique, (SELECT v {best}) AS top, (SELECT n {best}) AS freq"
        parts.append(f"SELECT '{c}' AS name, count({c}) AS count, {top}, {none}, {dates} FROM {source} t")
    return _union(parts)


def high_priority_issues(spark, sf):
    return P.high_priority_issues(dirty(spark, sf, "line_constant")).select("issue")


HIGH_SQL = _union([
    *[f"""SELECT '{c}: ' || printf('%.1f', pct) || '% of the cells are empty; suggested: ' ||
                 CASE WHEN pct > 50 THEN 'drop_row' ELSE '{fill}' END AS issue
          FROM {_line_missing(c)} WHERE pct > 20"""
      for c, fill in zip(_LINE_COLUMNS, ("median", "median", "mode", "mode"))],
    *[f"""SELECT '{c}: all cells hold the same value, or none'
          FROM {_line_missing(c)} WHERE uniq <= 1 AND n > 1""" for c in _LINE_COLUMNS],
    f"""SELECT k || ' rows repeat others (' || printf('%.1f', 100.0 * k / n) || '% of the table)'
        FROM (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS k
              FROM (SELECT count(*) AS c FROM {dirty_sql('line_constant')} t GROUP BY {', '.join(_LINE_COLUMNS)}))
        WHERE 100.0 * k / n > 1""",
])


def quality_issues(spark, sf):
    found = Q.validate_dataset(dirty(spark, sf, "line_constant")).df
    return found.select("issue_type", "severity", F.array_join("affected_columns", ",").alias("affected_columns"),
                        "description", "suggested_fix", "penalty")


_ISSUES = _union([
    *[f"""SELECT 'high_missingness' AS issue_type,
                 CASE WHEN pct > 50 THEN 'error' WHEN pct > 20 THEN 'warning' ELSE 'info' END AS severity,
                 '{c}' AS affected_columns,
                 printf('%.1f', pct) || '% of {c} is empty' AS description,
                 'impute with ' || CASE WHEN pct > 50 THEN 'drop_row' ELSE '{fill}' END AS suggested_fix,
                 CAST(CASE WHEN pct > 50 THEN 10 WHEN pct > 20 THEN 5 ELSE 1 END AS DOUBLE) AS penalty
          FROM {_line_missing(c)} WHERE pct > 0"""
      for c, fill in zip(_LINE_COLUMNS, ("median", "median", "mode", "mode"))],
    f"""SELECT 'near_duplicates', CASE WHEN 100.0 * k / n > 5 THEN 'error' ELSE 'warning' END, '',
               k || ' rows repeat others (' || printf('%.1f', 100.0 * k / n) || '% of the table)',
               'run deduplicate_dataset', CAST(CASE WHEN 100.0 * k / n > 5 THEN 8 ELSE 3 END AS DOUBLE)
        FROM (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c - 1) AS BIGINT) AS k
              FROM (SELECT count(*) AS c FROM {dirty_sql('line_constant')} t GROUP BY {', '.join(_LINE_COLUMNS)}))
        WHERE 100.0 * k / n > 1""",
    *[f"""SELECT 'constant_column', 'warning', '{c}',
                 '{c} never changes', 'leave the column out', CAST(2 AS DOUBLE)
          FROM {_line_missing(c)} WHERE uniq <= 1 AND n > 1""" for c in _LINE_COLUMNS],
])


def quality_score(spark, sf):
    return Q.validate_dataset(dirty(spark, sf, "line_constant")).summary.select("quality_score", "passed", "n_issues")


SCORE_SQL = f"""
    SELECT score AS quality_score, score >= 70 AS passed, n AS n_issues
    FROM (SELECT greatest(0.0, least(100.0, 100.0 - sum(penalty))) AS score, CAST(count(*) AS INTEGER) AS n
          FROM ({_ISSUES}) i)"""


def mixed_types(spark, sf):
    """Numeric text with words in between: every order whose status is 'F' names it instead of its number."""
    mixed = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", F.lit("closed")).otherwise(F.col("o_custkey").cast("string")).alias("ref"),
        F.col("o_orderkey").cast("string").alias("all_numbers"), "o_orderpriority")
    found = Q.validate_dataset(mixed, rules="extended").df
    return found.where("issue_type = 'mixed_types'").select(
        F.array_join("affected_columns", ",").alias("name"), "severity", "penalty")


MIXED_SQL = """
    SELECT 'ref' AS name, 'warning' AS severity, CAST(3 AS DOUBLE) AS penalty
    FROM (SELECT count(TRY_CAST(ref AS DOUBLE)) / count(ref) AS share
          FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE CAST(o_custkey AS VARCHAR) END AS ref FROM orders))
    WHERE share BETWEEN 0.05 AND 0.95"""

def high_cardinality(spark, sf):
    """Nearly unique text beside text of few values."""
    orders = table(spark, sf, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), "o_orderpriority",
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("buyer"))
    found = Q.validate_dataset(orders, rules="extended").df.where("issue_type = 'high_cardinality'")
    return found.select(F.array_join("affected_columns", ",").alias("name"), "severity", "description", "penalty")


CARDINALITY_SQL = _union([
    f"""SELECT '{name}' AS name, 'info' AS severity,
               u || ' different values in {name}, ' || printf('%.1f', 100.0 * u / n) || '% of the rows' AS description,
               CAST(1 AS DOUBLE) AS penalty
        FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM orders) WHERE u / n > 0.9"""
    for name, c in (("title", "o_orderkey"), ("buyer", "o_custkey"))])

QUERIES = {
    "high_cardinality": (high_cardinality, CARDINALITY_SQL),
    "profile_columns": (profile_columns, _profile_columns_sql()),
    "profile_dataset": (profile_dataset, PROFILE_DATASET_SQL),
    "missingness_overview": (missingness_overview, MISSINGNESS_SQL),
    "duplicate_count": (duplicate_count, DUPLICATE_SQL),
    "numeric_stats": (numeric_stats, NUMERIC_SQL),
    "percentiles_own_type": (percentiles_own_type, PERCENTILES_SQL),
    "top_values": (top_values, TOP_SQL),
    "entropy": (entropy, ENTROPY_SQL),
    "datetime_stats": (datetime_stats, DATETIME_SQL),
    "infer_logical_type": (infer_logical_type, LOGICAL_SQL),
    "iqr_outliers": (iqr_outliers, OUTLIER_SQL),
    "flag_outliers": (flag_outliers, FLAG_SQL),
    "column_anomalies": (column_anomalies, ANOMALY_SQL),
    "describe_all": (describe_all, _describe_sql()),
    "high_priority_issues": (high_priority_issues, HIGH_SQL),
    "quality_issues": (quality_issues, _ISSUES),
    "quality_score": (quality_score, SCORE_SQL),
    "mixed_types": (mixed_types, MIXED_SQL),
}
