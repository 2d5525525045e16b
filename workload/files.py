"""Queries of the sources, sinks, snapshots and checksums, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkclean.audit import LOG_SCHEMA, StepLog, StepResult, table_checksum
from sparkclean.operators.impute import handle_missing_values
from sparkclean.operators.profile import profile_columns
from sparkclean.plans.cleaning import CleaningPlan, Step
from sparkclean.sources import files
from sparkclean.sources.scratch import scratch_path
from sparkclean.sources.snapshots import Snapshots, write_csv
from workload.tables import dirty, dirty_sql, table


def load_parquet(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return files.load_dataset(spark, f"{sf}/lineitem.parquet").df


def csv_roundtrip(spark, sf):
    """Write a table with NULLs and line breaks as CSV and load it again with inferred types."""
    df = table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "NULLIF(role, 'system') AS role", "text",
        "conv_id / 4 AS quarter", "turn = 0 AS opening")
    path = scratch_path(spark, "roundtrip")
    write_csv(df, path)
    return files.load_dataset(spark, path, format="csv").df


CSV_SQL = """
    SELECT conv_id, turn, NULLIF(role, 'system') AS role, text, conv_id / 4 AS quarter, turn = 0 AS opening FROM conversations"""


def infer_types(spark, sf):
    df = table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS whole", "CAST(c_acctbal AS STRING) AS fraction",
        "CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS flag", "c_mktsegment AS word",
        "CASE WHEN c_acctbal < 0 THEN 'x' ELSE CAST(c_custkey AS STRING) END AS mixed")
    return files.infer_types(df)


INFER_SQL = """
    WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS whole, CAST(c_acctbal AS VARCHAR) AS fraction,
                      CASE WHEN c_acctbal < 0 THEN 'True' ELSE 'False' END AS flag, c_mktsegment AS word,
                      CASE WHEN c_acctbal < 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END AS mixed FROM customer),
    u AS (UNPIVOT t ON whole, fraction, flag, word, mixed INTO NAME name VALUE v)
    SELECT name, CASE WHEN count(*) = count(*) FILTER (regexp_full_match(v, '[+-]?[0-9]+')) THEN 'bigint'
                      WHEN count(*) = count(TRY_CAST(v AS DOUBLE)) THEN 'double'
                      WHEN count(*) = count(*) FILTER (v IN ('True', 'False')) THEN 'boolean' ELSE 'string' END
                 AS inferred_dtype
    FROM u GROUP BY name"""


def schema_summary(spark, sf):
    return files.schema_summary(dirty(spark, sf, "dirty_events"), order_by="event_id")


_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "value": "double",
          "event_type": "string", "props": "string"}
SUMMARY_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, '{t}' AS dtype, coalesce((SELECT CAST({c} AS VARCHAR) FROM {dirty_sql('dirty_events')} t
        WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 1), '') AS sample""" for c, t in _TYPES.items())


def snapshot_roundtrip(spark, sf):
    """Two versions of a step are written; the second is read back by its key."""
    df = dirty(spark, sf, "dirty_orders")
    store = Snapshots(spark, scratch_path(spark, "snapshots"))
    loaded = store.write(StepResult(df, StepLog("load_dataset", 0, len(df.columns), 1.0)))
    store.write(handle_missing_values(df, {"o_totalprice": "drop_row"}), loaded)
    key = store.write(handle_missing_values(df, {"o_orderstatus": "drop_row"}), loaded)
    return store.read(key)


SNAPSHOT_SQL = f"SELECT * FROM {dirty_sql('dirty_orders')} t WHERE o_orderstatus IS NOT NULL"


def lineage_latest(spark, sf):
    """The newest version of each step, with the key it was made from."""
    df = dirty(spark, sf, "dirty_orders")
    store = Snapshots(spark, scratch_path(spark, "lineage"))
    loaded = store.write(StepResult(df, StepLog("load_dataset", 0, len(df.columns), 1.0)))
    store.write(handle_missing_values(df, {"o_totalprice": "median"}), loaded)
    store.write(handle_missing_values(df, {"o_totalprice": "drop_row"}), loaded)
    return store.latest().select("artifact_key", "step_name", "version", "row_count", "col_count", "input_key")


LINEAGE_SQL = f"""
    SELECT 'load_dataset/v1/dataset' AS artifact_key, 'load_dataset' AS step_name, CAST(1 AS INTEGER) AS version,
           count(*) AS row_count, CAST(6 AS INTEGER) AS col_count, CAST(NULL AS VARCHAR) AS input_key FROM orders
    UNION ALL
    SELECT 'handle_missing_values/v2/dataset', 'handle_missing_values', 2, count(o_totalprice), 6,
           'load_dataset/v1/dataset' FROM {dirty_sql('dirty_orders')} t"""


def profile_written(spark, sf):
    """The profile of a table, written as a version of its own and read back."""
    df = table(spark, sf, "events").select("user_id", "event_type", "value")
    store = Snapshots(spark, scratch_path(spark, "profiles"))
    log = StepLog("profile_dataset", 3, 3, 1.0)
    key = store.write_summary("profile_dataset", "profile", profile_columns(df), log)
    return spark.read.json(store.path(key)).select("name", "inferred_type", "missing_count", "unique_count")


PROFILE_SQL = """
    SELECT 'user_id' AS name, 'numeric' AS inferred_type, count(*) - count(user_id) AS missing_count,
           count(DISTINCT user_id) AS unique_count FROM events
    UNION ALL SELECT 'event_type', 'categorical', count(*) - count(event_type), count(DISTINCT event_type) FROM events
    UNION ALL SELECT 'value', 'numeric', count(*) - count(value), count(DISTINCT value) FROM events"""


def _shuffled(df, key):
    """The rows in another order, in partitions of bounded size: their number follows the table."""
    return df.hint("rebalance", key)


def checksum(spark, sf):
    """The same rows in another order and partitioning give the same checksum."""
    df = table(spark, sf, "lineitem")
    one, two = table_checksum(df), table_checksum(_shuffled(df, "l_partkey"))
    same = one.unionByName(two).agg(F.count_distinct("hash_sum").alias("checksums"), F.max("row_count").alias("row_count"))
    return same


CHECKSUM_SQL = "SELECT CAST(1 AS BIGINT) AS checksums, count(*) AS row_count FROM lineitem"

def checksum_differs(spark, sf):
    """Four tables, three contents: as it is, in another order, with other taxes on returns, and each row twice."""
    df = table(spark, sf, "lineitem")
    taxed = df.withColumn("l_tax", F.when(F.col("l_returnflag") == "R", F.col("l_tax") + 0.01).otherwise(F.col("l_tax")))
    parts = [table_checksum(x) for x in (df, _shuffled(df, "l_suppkey"), taxed, df.union(df))]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.agg(F.count_distinct("hash_sum").alias("checksums"), F.max("row_count").alias("row_count"))


DIFFERS_SQL = "SELECT CAST(3 AS BIGINT) AS checksums, 2 * count(*) AS row_count FROM lineitem"


def audit_log_written(spark, sf):
    """The log of a plan as it was exported, read back."""
    store = Snapshots(spark, scratch_path(spark, "audit"))
    done = CleaningPlan([
        Step("handle_missing_values", {"strategy_config": {"o_totalprice": "drop_row", "o_orderstatus": "mode"}, "drop_threshold": 1.0}),
        Step("profile_dataset"),
        Step("validate_dataset"),
        Step("generate_output", {"include_summary_stats": False}),
    ]).run(dirty(spark, sf, "dirty_orders"), store)
    if done.error:
        raise done.error
    logs = spark.read.schema(LOG_SCHEMA).json(store.path(done.results[-1].log_key))
    return logs.select("step_name", "rows_before", "rows_after", "rows_removed", "cells_modified")


AUDIT_SQL = f"""
    WITH n AS (SELECT count(*) AS a, count(o_totalprice) AS b,
                      count(*) FILTER (o_totalprice IS NOT NULL AND o_orderstatus IS NULL) AS gaps FROM {dirty_sql('dirty_orders')} t)
    SELECT 'handle_missing_values' AS step_name, a AS rows_before, b AS rows_after, a - b AS rows_removed, a - b + gaps AS cells_modified FROM n
    UNION ALL SELECT 'profile_dataset', b, b, 0, 0 FROM n
    UNION ALL SELECT 'validate_dataset', b, b, 0, 0 FROM n"""

QUERIES = {
    "table_checksum_differs": (checksum_differs, DIFFERS_SQL),
    "audit_log_written": (audit_log_written, AUDIT_SQL),
    "load_parquet": (load_parquet, "SELECT * FROM lineitem"),
    "csv_roundtrip": (csv_roundtrip, CSV_SQL),
    "infer_types": (infer_types, INFER_SQL),
    "schema_summary": (schema_summary, SUMMARY_SQL),
    "snapshot_roundtrip": (snapshot_roundtrip, SNAPSHOT_SQL),
    "lineage_latest": (lineage_latest, LINEAGE_SQL),
    "profile_written": (profile_written, PROFILE_SQL),
    "table_checksum": (checksum, CHECKSUM_SQL),
}
