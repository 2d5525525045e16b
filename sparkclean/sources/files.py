"""Loading CSV and Parquet files as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.sources.csv_records import read_split
from sparkclean.audit import Lineage, StepLog, StepResult
from sparkclean.functions.missing import col, columns_of, null_tokens
from sparkclean.functions.parsing import try_bool, try_long, try_num

FORMATS = {".csv": "csv", ".parquet": "parquet"}


@dataclass
class LoadResult(StepResult):
    name: str | None = None


def _suffix(path: str) -> str:
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + last.rsplit(".", 1)[-1].lower() if "." in last else ""


def path_is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def load_dataset(
    spark: SparkSession, path: str, format: str | None = None, is_secondary: bool = False,
    secondary_name: str | None = None, multiline: bool | None = None,
) -> LoadResult:
    """Load a CSV or Parquet file or folder, chosen by suffix or by `format`.

    A secondary (lookup) table needs a name and is registered as a temporary view under it.
    """
    if is_secondary and not secondary_name:
        raise ValueError("a secondary dataset needs secondary_name")
    kind = format or FORMATS.get(_suffix(path))
    if kind not in FORMATS.values():
        raise ValueError(f"{path}: {format or _suffix(path)!r} is neither CSV nor Parquet")
    try:
        df = read_csv(spark, path, multiline) if kind == "csv" else spark.read.parquet(path)
    except AnalysisException as error:
        if path_is_missing(error):
            raise FileNotFoundError(f"File not found: {path}") from error
        raise
    if is_secondary:
        df.createOrReplaceTempView(secondary_name)
    log = StepLog("load_dataset", 0, len(df.columns), 1.0, 0, None,
                  column_lineage=Lineage(columns_added=df.columns),
                  detail={"dataset_identifier": path, "format": kind, "is_secondary": is_secondary})
    return LoadResult(df, log, secondary_name)


def spans_lines(spark: SparkSession, path: str) -> bool:
    """May a quoted CSV field hold a line break? Only if some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.max(quotes % 2).alias("odd")).first()
    return bool(row["odd"])


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """CSV with a header row; NA tokens become NULL, then column types are inferred in one pass.

    Fields may hold line breaks. By default a cheap pass looks for such fields first; files that have them are cut at
    the true ends of their records. `multiline` True reads each file whole in one task, False by lines.
    """
    split = multiline is None and spans_lines(spark, path)
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    raw = spark.read.options(**options).option("header", True).option("inferSchema", False).option("multiLine", split or bool(multiline)).csv(path)
    return cast_inferred(null_tokens(read_split(spark, path, raw, options) if split else raw))


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Narrowest type that holds every value of each text column: bigint, double, boolean or string.

    One aggregate for all columns. A column without values is double, a table without rows all string.
    """
    texts = columns_of(df, (T.StringType,))
    if not texts:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(texts):
        aggs += [F.count(col(c)).alias(f"n{i}"), F.count(try_long(col(c))).alias(f"l{i}"),
                 F.count(try_num(col(c))).alias(f"d{i}"), F.count(try_bool(col(c))).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        if not row["rows"]:
            out[c] = "string"
        elif n and row[f"l{i}"] == n:
            out[c] = "bigint"
        elif row[f"d{i}"] == n:
            out[c] = "double"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def cast_inferred(df: DataFrame) -> DataFrame:
    parsers = {"bigint": try_long, "double": try_num, "boolean": try_bool}
    found = inferred_types(df)
    return df.withColumns({c: parsers[t](col(c)) for c, t in found.items() if t in parsers})


def infer_types(df: DataFrame) -> DataFrame:
    found = inferred_types(df)
    return df.sparkSession.createDataFrame(list(found.items()), "name string, inferred_dtype string")


def schema_summary(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(name, dtype, sample): the first non-null value in the order of `order_by`, "" if there is none.

    Without an order any non-null value may be shown.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], "name string, dtype string, sample string")
    samples = []
    for i, c in enumerate(df.columns):
        text = col(c).cast("string")
        if order_by is None:
            pick = F.first(text, ignorenulls=True)
        else:
            pick = F.min_by(text, F.when(col(c).isNotNull(), col(order_by)))
        samples.append(F.coalesce(pick, F.lit("")).alias(f"s{i}"))
    row = df.agg(*samples).first()
    out = [(c, t, row[f"s{i}"]) for i, (c, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(out, "name string, dtype string, sample string")


def with_row_order(df: DataFrame, name: str = "row_order") -> DataFrame:
    """Add the position of each row in its Parquet file, for operators that need an order."""
    return df.select("*", F.struct(
        col("_metadata").getField("file_path").alias("file"),
        col("_metadata").getField("row_index").alias("row")).alias(name))
