"""Step results and the record each step leaves in the audit log."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.missing import NESTED_TYPES, col

LINEAGE_TYPE = T.StructType([
    T.StructField("columns_added", T.ArrayType(T.StringType())),
    T.StructField("columns_removed", T.ArrayType(T.StringType())),
    T.StructField("columns_renamed", T.MapType(T.StringType(), T.StringType())),
    T.StructField("type_changes", T.MapType(T.StringType(), T.StructType([
        T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))),
])

LOG_SCHEMA = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("step_name", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("rows_before", T.LongType()),
    T.StructField("rows_after", T.LongType()),
    T.StructField("cols_before", T.IntegerType()),
    T.StructField("cols_after", T.IntegerType()),
    T.StructField("rows_removed", T.LongType()),
    T.StructField("cells_modified", T.LongType()),
    T.StructField("column_lineage", LINEAGE_TYPE),
    T.StructField("checksum_before", T.StringType()),
    T.StructField("checksum_after", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("operation_detail", T.StringType()),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])


@dataclass
class Lineage:
    columns_added: list[str] = field(default_factory=list)
    columns_removed: list[str] = field(default_factory=list)
    columns_renamed: dict[str, str] = field(default_factory=dict)
    type_changes: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass
class StepLog:
    """One entry of the audit log.

    Row counts and checksums that the step did not need stay None until its output is written:
    the snapshot write observes them on the way, so no extra pass over the data is made.
    """

    step_name: str
    cols_before: int
    cols_after: int
    confidence: float
    rows_before: int | None = None
    rows_after: int | None = None
    cells_modified: int = 0
    column_lineage: Lineage = field(default_factory=Lineage)
    checksum_before: str = ""
    checksum_after: str = ""
    detail: dict[str, Any] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    log_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @property
    def rows_removed(self) -> int:
        if self.rows_before is None or self.rows_after is None or self.step_name in ROW_ADDING_STEPS:
            return 0
        return self.rows_before - self.rows_after

    def as_row(self) -> dict[str, Any]:
        return {
            "log_id": self.log_id, "step_name": self.step_name, "timestamp": self.timestamp,
            "rows_before": self.rows_before, "rows_after": self.rows_after,
            "cols_before": self.cols_before, "cols_after": self.cols_after,
            "rows_removed": self.rows_removed, "cells_modified": self.cells_modified,
            "column_lineage": {
                **asdict(self.column_lineage),
                "type_changes": {c: {"old": old, "new": new}
                                 for c, (old, new) in self.column_lineage.type_changes.items()},
            },
            "checksum_before": self.checksum_before, "checksum_after": self.checksum_after,
            "confidence": float(self.confidence),
            "operation_detail": json.dumps(self.detail, default=str),
            "warnings": self.warnings,
        }


# Steps whose row count does not fall by removal of rows.
ROW_ADDING_STEPS = frozenset({"load_dataset", "merge_datasets"})


@dataclass
class StepResult:
    df: DataFrame
    log: StepLog


def audit_log(spark: SparkSession, logs: list[StepLog]) -> DataFrame:
    return spark.createDataFrame([log.as_row() for log in logs], LOG_SCHEMA)


def schema_digest(df: DataFrame) -> str:
    """MD5 over the sorted column names and types; changes when the schema drifts."""
    return hashlib.md5(json.dumps(dict(df.dtypes), sort_keys=True).encode()).hexdigest()


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """64-bit hash of a row. A null flag goes with each cell, as xxhash64 skips nulls. Each seed gives another hash."""
    cells = [F.lit(seed)] if seed else []
    for f in df.schema:
        value = F.to_json(col(f.name)) if isinstance(f.dataType, NESTED_TYPES) else col(f.name)
        cells += [value, col(f.name).isNull()]
    return F.xxhash64(*cells) if cells else F.lit(0).cast("bigint")


def checksum_columns(df: DataFrame) -> list[Column]:
    """Aggregates that make up the checksum: row count and the sum of row hashes.

    A sum, not an xor: pairs of identical rows must not cancel. Row order does not matter.
    """
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash(df).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"),
    ]


def table_checksum(df: DataFrame) -> DataFrame:
    return df.agg(*checksum_columns(df))


def checksum_text(row_count: int, hash_sum: Any) -> str:
    return f"{row_count}:{int(hash_sum)}"
