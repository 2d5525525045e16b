"""Text keys of rows for fuzzy comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.missing import FLOAT_TYPES, col

SEPARATOR = " | "


def float_text(c: Column) -> Column:
    """Plain digits from 1e-4 up to 1e16, exponent form (1.5e-05) beyond; always shortest round-trip."""
    text, size = c.cast("string"), F.abs(c)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    digits = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when((size >= 1e-3) & (size < 1e7) | (size == 0), text)
        .when((size >= 1e-4) & (size < 1e16), digits)
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .otherwise(exponent)
    )


def cell_text(name: str, dtype: T.DataType) -> Column:
    c = col(name)
    if isinstance(dtype, FLOAT_TYPES):
        text = float_text(c.cast("double"))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, "True").otherwise(F.when(~c, "False"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def composite_key(df: DataFrame, names: list[str], separator: str = SEPARATOR) -> Column:
    types = {f.name: f.dataType for f in df.schema}
    return F.concat_ws(separator, *[cell_text(c, types[c]) for c in names])


def tokens_of(text: Column) -> Column:
    """Words between white space, in order, duplicates kept; an empty array for blank text."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda word: word != "")


def token_set_key(df: DataFrame, names: list[str]) -> Column:
    """Sorted distinct words of the columns. The separator is no word, so blank rows have a blank key."""
    return F.array_join(F.array_sort(F.array_distinct(tokens_of(composite_key(df, names, " ")))), " ")
