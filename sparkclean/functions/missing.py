"""What counts as a missing value.

Missing means NULL or NaN. Spark treats NaN as an ordinary (largest) number, so every operator maps
NaN to NULL on its input first. +/-Infinity is a value; it is only left out of reported statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens a CSV reader of tabular data takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = (T.NumericType,)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots, blanks or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in all float columns; a no-op plan when there are none."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, FLOAT_TYPES)]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


def null_tokens(df: DataFrame) -> DataFrame:
    """Replace the NA tokens by NULL in all string columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~col(c).isin(*NA_TOKENS), col(c)) for c in texts})


def columns_of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, TIME_TYPES)


def as_text(name: str, dtype: T.DataType) -> Column:
    """A text form under which two cells are equal exactly when their values are equal."""
    c = col(name)
    if isinstance(dtype, NESTED_TYPES):
        return F.to_json(c)
    if isinstance(dtype, FLOAT_TYPES):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))  # -0.0 and 0.0 are one value
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")
