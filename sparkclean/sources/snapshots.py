"""Versioned Parquet snapshots with lineage, and export of the final table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkclean.audit import StepLog, StepResult, audit_log, checksum_columns, checksum_text, schema_digest
from sparkclean.sources.files import path_is_missing

KINDS = ("dataset", "profile", "log", "report")

VERSIONS_SCHEMA = (
    "artifact_key string, step_name string, version int, row_count long, col_count int, checksum string, "
    "schema_digest string, created_at timestamp, input_key string, step_key string"
)


def artifact_key(step: str, version: int, kind: str = "dataset") -> str:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    return f"{step}/v{version}/{kind}"


class Snapshots:
    """Snapshots under one root folder on any Hadoop file system.

    The versions table is itself a folder of small JSON files, one per version, so a writer only adds. A version exists
    once it is registered there. Any number of writers may work at once: each claims its version first, by creating a file
    that must not exist yet, and takes the next number where another writer was faster. A writer that dies leaves its claim
    behind, and its number unused; data under a number that nobody claimed is replaced. The step key of a version says
    what made it (step, arguments, input), so that a plan finds what it has done before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.logs: list[StepLog] = []

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSIONS_SCHEMA).option("recursiveFileLookup", True).json(f"{self.root}/_versions")
        except AnalysisException as error:
            if not path_is_missing(error):
                raise
            return self.spark.createDataFrame([], VERSIONS_SCHEMA)

    def _claims(self, step: str) -> list[int]:
        """Versions that writers have claimed, from the names in one folder."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{step}")
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return [int(x.getPath().getName()[1:]) for x in files.listStatus(folder) if x.getPath().getName()[1:].isdigit()]

    def _created(self, step: str, version: int) -> bool:
        """Create the claim of a version; False if it is there already. Atomic: files are created only if absent."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_claims/{step}/v{version}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(place.getParent())
        if files.getScheme() == "file":
            return jvm.java.io.File(place.toUri().getPath()).createNewFile()
        try:
            files.create(place, False).close()
        except Py4JJavaError as error:
            if files.exists(place):
                return False
            raise error
        return True

    def claim(self, step: str) -> int:
        """A version of a step that belongs to this writer alone."""
        version = max([*self._claims(step), self.next_version(step) - 1]) + 1
        while not self._created(step, version):
            version += 1
        return version

    def made_by(self, step_key: str) -> dict | None:
        """The newest version that a step key has made, if any."""
        found = self.versions().where(F.col("step_key") == step_key).orderBy(F.desc("version")).first()
        return found.asDict() if found else None

    def next_version(self, step: str) -> int:
        newest = self.versions().where(F.col("step_name") == step).agg(F.max("version")).first()[0]
        return (newest or 0) + 1

    def write(self, result: StepResult, input_key: str | None = None, step_key: str | None = None) -> str:
        """Write the output of a step. Row count and checksum are observed during the write itself."""
        log, df = result.log, result.df
        version = self.claim(log.step_name)
        key = artifact_key(log.step_name, version)
        watch = Observation()
        df.observe(watch, *checksum_columns(df)).write.mode("overwrite").parquet(self.path(key))
        seen = watch.get
        log.rows_after, log.checksum_after = seen["row_count"], checksum_text(seen["row_count"], seen["hash_sum"])
        before = self.versions().where(F.col("artifact_key") == input_key).first() if input_key else None
        if before:
            log.rows_before, log.checksum_before = before["row_count"], before["checksum"]
        self.register(key, log.step_name, version, df, seen["row_count"], log.checksum_after, input_key, step_key)
        self.logs.append(log)
        return key

    def write_summary(self, step: str, kind: str, df: DataFrame, log: StepLog, input_key: str | None = None, step_key: str | None = None) -> str:
        """Write a small table about a dataset (profile, quality report) as a version of its own."""
        version = self.claim(step)
        key = artifact_key(step, version, kind)
        df.coalesce(1).write.mode("overwrite").json(self.path(key))
        self.register(key, step, version, df, log.rows_after, "", input_key, step_key)
        self.logs.append(log)
        return key

    def register(self, key, step, version, df, rows, checksum, input_key, step_key=None) -> None:
        row = (key, step, version, rows, len(df.columns), checksum, schema_digest(df),
               datetime.now(timezone.utc), input_key, step_key)
        one = self.spark.createDataFrame([row], VERSIONS_SCHEMA).coalesce(1)
        one.write.mode("append").json(f"{self.root}/_versions/{step}-v{version}")  # writers of one folder would be in each other's way

    def read(self, key: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path(key))
        except AnalysisException as error:
            if path_is_missing(error):
                raise FileNotFoundError(f"no snapshot under key {key}") from error
            raise

    def latest(self) -> DataFrame:
        """The newest version of each step."""
        versions = self.versions()
        newest = versions.groupBy("step_name").agg(F.max_by(F.struct(*versions.columns), "version").alias("v"))
        return newest.select("v.*")

    def all_keys(self) -> DataFrame:
        return self.versions().select("artifact_key")

    def parents(self) -> DataFrame:
        """(artifact_key, input_key, input_step): each version with what it was made from."""
        child, parent = self.versions(), self.versions().select(
            F.col("artifact_key").alias("input_key"), F.col("step_name").alias("input_step"))
        return child.join(parent, "input_key", "left").select("artifact_key", "input_key", "input_step")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; NULL is an empty cell. One file per task unless a single file is asked for."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("errorifexists").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def write_audit_log(spark: SparkSession, logs: list[StepLog], path: str) -> None:
    """The audit log as JSON lines."""
    audit_log(spark, logs).coalesce(1).write.mode("errorifexists").json(path)


def logs_as_json(logs: list[StepLog]) -> str:
    return json.dumps([log.as_row() for log in logs], indent=2, default=str)
