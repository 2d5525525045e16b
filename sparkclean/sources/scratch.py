"""Written intermediate tables in the folder all executors share.

An iterative step must cut its lineage, and a step that fixes row identities must fix them once. Both
write a Parquet table under `spark.checkpoint.dir`: it survives the loss of executors, keeps column
pruning, and gives the next plan real sizes to choose joins by.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is not set, one under the warehouse, which executors share, too."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def _drop_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete a folder when the application ends: lazy results may read it until then."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _drop_at_end(spark, path)
    return path


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read any more: what was made from them is itself written."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        if files:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and return it as a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
