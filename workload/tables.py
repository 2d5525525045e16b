"""The given tables, and tables made dirty from them by plain SQL expressions.

The tables hold no NULLs and no copies, so NULLs are put in by predicates on the data itself and copies
come from leaving out key columns. All rows are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# name -> (source table, select list). The list is SQL that Spark and the checking engine both read.
DIRTY = {
    "dirty_events": ("events", [
        "event_id", "ts", "user_id",
        "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value",
        "NULLIF(event_type, 'signup') AS event_type",
        "CASE WHEN event_type IN ('click', 'view', 'error') THEN NULL ELSE props END AS props",
    ]),
    "dirty_orders": ("orders", [
        "o_orderkey", "o_custkey", "NULLIF(o_orderstatus, 'P') AS o_orderstatus",
        "CASE WHEN o_totalprice < 150000 THEN NULL ELSE o_totalprice END AS o_totalprice",
        "o_orderdate", "NULLIF(o_orderpriority, '1-URGENT') AS o_orderpriority",
    ]),
    # No key column: many equal rows.
    "line_shapes": ("lineitem", [
        "l_quantity", "l_discount", "NULLIF(l_returnflag, 'R') AS l_returnflag", "l_linestatus",
    ]),
    "line_constant": ("lineitem", [
        "l_quantity", "CASE WHEN l_linestatus = 'O' THEN l_tax END AS l_tax",
        "CASE WHEN l_quantity > 45 THEN l_returnflag END AS l_returnflag", "'shipped' AS state",
    ]),
}


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = DIRTY[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def dirty_sql(name: str) -> str:
    source, columns = DIRTY[name]
    return f"(SELECT {', '.join(columns)} FROM {source})"
