"""Exact percentiles by a distributed radix select.

Each value becomes one whole number of 64 bits (several for wide decimals) in the order of the values: integers and times
as they are, decimals without their point. A pass counts, for every wanted rank at once, the leading digits of the numbers in
the range that is known to hold the rank; the digit that holds it is the next range. Doubles stay as they are: their digit
is the place in the range, or, after a pass in which one place held most values, the exponent. Counts are formed before the shuffle, no value is rounded, and no task sees a whole column.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from math import ceil, floor, frexp, isfinite
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.functions.missing import FLOAT_TYPES, col

# Bits of a digit, and rows in all open ranges from which on their distinct values are read at once.
DIGIT_BITS, READ_ROWS = 12, 20_000
# Digits of one word of a wide decimal, from the last on.
WIDE_DIGITS, WIDE_WORDS = 13, 3


def _steep_digit(x: Column) -> Column:
    """Sign and exponent of a double as one whole number, in the order of the values."""
    size = F.floor(F.least(F.coalesce(F.log2(F.abs(x)), F.lit(-1075.0)), F.lit(1024.0))) + 1076
    return F.when(x < 0, -size).otherwise(size)


def is_wide(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.DecimalType) and dtype.precision > 18


def order_words(name: str, dtype: T.DataType) -> list[Column]:
    """Whole numbers, or one double without NaN and -0, whose order, the first before the next, is that of the values."""
    c = col(name)
    if isinstance(dtype, FLOAT_TYPES):
        x = c.cast("double")
        return [F.when(x == 0, F.lit(0.0)).when(~F.isnan(x), x)]
    if is_wide(dtype):
        text = F.replace(F.replace(F.format_number(F.abs(c), dtype.scale), F.lit(","), F.lit("")), F.lit("."), F.lit(""))
        digits = F.lpad(text, WIDE_DIGITS * WIDE_WORDS, "0")
        sign = F.when(c < 0, -1).otherwise(1).cast("bigint")
        return [sign * F.substring(digits, 1 + WIDE_DIGITS * k, WIDE_DIGITS).cast("bigint") for k in range(WIDE_WORDS)]
    if isinstance(dtype, T.DecimalType):
        return [(c * F.lit(Decimal(10) ** dtype.scale).cast(T.DecimalType(dtype.scale + 1, 0))).cast("bigint")]
    return [c.cast("bigint")]


def value_of(words: tuple[int, ...], dtype: T.DataType) -> Any:
    if isinstance(dtype, FLOAT_TYPES):
        return words[0]
    if isinstance(dtype, T.DecimalType):
        return Decimal(reduce(lambda a, b: a * 10**WIDE_DIGITS + b, words)).scaleb(-dtype.scale)
    return words[0]


@dataclass(frozen=True)
class Range:
    """Values whose earlier words are `fixed` and whose next one is from lo to hi, and the number of those below them."""

    column: str
    fixed: tuple[Any, ...]
    lo: Any
    hi: Any
    below: int
    inside: int
    steep: bool = False

    def digit(self, own: Column, bits: int) -> Column:
        """A number of about `bits` bits that does not fall where the word rises, and differs between lo and hi."""
        if not isinstance(self.lo, float):
            return F.shiftright(own, max(0, (self.hi - self.lo).bit_length() - bits))
        if self.by_exponent():
            return _steep_digit(own)
        # Made large first: no division by a width near the smallest double.
        up = 2.0**1000 if self.hi - self.lo < 1 else 1.0
        return F.floor((own - self.lo) * up * ((1 << bits) / ((self.hi - self.lo) * up)))

    def by_exponent(self) -> bool:
        return not isfinite(self.hi - self.lo) or self.steep and self.spans_exponents()

    def spans_exponents(self) -> bool:
        return self.lo <= 0 <= self.hi or frexp(self.lo)[1] != frexp(self.hi)[1]


def between(left: Any, right: Any, share: float) -> Any:
    """The value at `share` of the way between two neighbours; exact for integers and decimals if it can be."""
    if left == right or not share:
        return left
    if isinstance(left, float):
        return left + (right - left) * share
    found = Fraction(left) + (Fraction(right) - Fraction(left)) * Fraction(share)
    if isinstance(left, int):
        return found.numerator if found.denominator == 1 else float(found)
    return Decimal(found.numerator) / Decimal(found.denominator)


def neighbours(
    df: DataFrame, probs: dict[str, list[float]], read_rows: int = READ_ROWS, bits: int = DIGIT_BITS,
    known: dict[str, tuple[int, int | None, int | None]] | None = None,
) -> dict[str, list[tuple[Any, Any, float]]]:
    """The values below and above each percentile, in the column's own type, and how far it is between them.

    A column without values has (None, None, 0). Columns are integers, decimals, floats or anything cast to bigint by its order; NULL and NaN are left out. `known`
    gives the count of values, and least and greatest first word, of each column where the caller has them.
    """
    names, types = list(probs), {f.name: f.dataType for f in df.schema}
    if not names:
        return {}
    words = {c: order_words(c, types[c]) for c in names}
    last = {c: len(words[c]) - 1 for c in names}
    numbers = df.select(*[w.alias(f"w{i}_{k}") for i, c in enumerate(names) for k, w in enumerate(words[c])])
    word = {c: [F.col(f"w{i}_{k}") for k in range(last[c] + 1)] for i, c in enumerate(names)}
    if known is None:
        row = numbers.agg(*[f(word[c][0]).alias(f"{f.__name__}{i}") for i, c in enumerate(names) for f in (F.count, F.min, F.max)]).first()
        known = {c: (row[f"count{i}"], row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(names)}
    targets: dict[tuple[str, int], Range] = {}
    for c in names:
        n, lo, hi = known[c]
        for p in probs[c] if n else []:
            for rank in {floor(p * (n - 1)), ceil(p * (n - 1))}:
                targets[c, rank] = _opened(Range(c, (), lo, hi, 0, n), last)

    def open_ranges() -> list[Range]:
        return list(dict.fromkeys(r for r in targets.values() if len(r.fixed) <= last[r.column]))

    def within(r: Range) -> Column:
        return reduce(Column.__and__, [w == v for w, v in zip(word[r.column], r.fixed)] + [word[r.column][len(r.fixed)].between(r.lo, r.hi)])

    while todo := open_ranges():
        if sum(r.inside for r in todo) <= read_rows:
            _read(numbers, targets, todo, word, last, within)
            break
        cells = []
        for i, r in enumerate(todo):
            own = word[r.column][len(r.fixed)]
            whole, real = (own, F.lit(None).cast("double")) if not isinstance(r.lo, float) else (F.lit(None).cast("bigint"), own)
            cells.append(F.when(within(r), F.struct(F.lit(i).alias("r"), r.digit(own, bits).alias("digit"), whole.alias("whole"), real.alias("real"))))
        spelled = numbers.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("whole", "real") for f in (F.min, F.max)]
        counted = spelled.groupBy("r", "digit").agg(F.count("*").alias("n"), *ends).collect()
        by: dict[Range, list] = {r: [] for r in todo}
        for row in sorted(counted, key=lambda x: (x["r"], x["digit"])):
            kind = "real" if isinstance(todo[row["r"]].lo, float) else "whole"
            by[todo[row["r"]]].append({"n": row["n"], "lo": row[f"min_{kind}"], "hi": row[f"max_{kind}"]})
        for key, r in targets.items():
            below = r.below
            for row in by.get(r, ()):
                if key[1] < below + row["n"]:
                    crowded = isinstance(r.lo, float) and not r.by_exponent() and 2 * row["n"] > r.inside
                    targets[key] = _opened(Range(r.column, r.fixed, row["lo"], row["hi"], below, row["n"], crowded), last)
                    break
                below += row["n"]
    out: dict[str, list[tuple[Any, Any, float]]] = {}
    for c, ps in probs.items():
        n = known[c][0]
        at = [p * (n - 1) for p in ps] if n else []
        ends = [(*(value_of(targets[c, rank].fixed, types[c]) for rank in (floor(x), ceil(x))), x - floor(x)) for x in at]
        out[c] = ends if n else [(None, None, 0.0)] * len(ps)
    return out


def _opened(r: Range, last: dict[str, int]) -> Range:
    """A range of one word becomes that word, and the range of the next one if there is one."""
    if r.lo != r.hi:
        return r
    wide = 10**WIDE_DIGITS if len(r.fixed) < last[r.column] else 0
    return Range(r.column, (*r.fixed, r.lo), -wide, wide, r.below, r.inside)


def _read(numbers, targets, todo, word, last, within) -> None:
    """Find the ranks among the distinct values of the open ranges: READ_ROWS rows in all at most."""
    def cells_of(r: Range) -> list[Column]:
        if isinstance(r.lo, float):
            return [F.lit(None).cast("array<bigint>").alias("words"), word[r.column][0].alias("real")]
        return [F.array(*word[r.column]).alias("words"), F.lit(None).cast("double").alias("real")]

    cells = [F.when(within(r), F.struct(F.lit(i).alias("r"), *cells_of(r))) for i, r in enumerate(todo)]
    spelled = numbers.select(F.explode(F.array(*cells)).alias("x")).where("x is not null").select("x.*")
    values: dict[Range, list] = {r: [] for r in todo}
    for row in spelled.groupBy("r", "words", "real").agg(F.count("*").alias("n")).collect():
        values[todo[row["r"]]].append(((row["real"],) if row["words"] is None else tuple(row["words"]), row["n"]))
    for own in values.values():
        own.sort()
    for key, r in targets.items():
        below = r.below
        for found, n in values.get(r, ()):
            if key[1] < below + n:
                targets[key] = Range(r.column, found, 0, 0, below, n)
                break
            below += n


def percentile_values(df: DataFrame, probs: dict[str, list[float]], **how) -> dict[str, list[Any]]:
    """Exact, linearly interpolated percentiles; in the column's own type where that holds them. None without values."""
    return {c: [between(*x) for x in ends] for c, ends in neighbours(df, probs, **how).items()}


def exact_percentiles(df: DataFrame, probs: dict[str, list[float]], **how) -> dict[str, list[float | None]]:
    """`percentile_values`, rounded to double once at the end."""
    return {c: [None if v is None else float(v) for v in values] for c, values in percentile_values(df, probs, **how).items()}


def percentile_table(df: DataFrame, probs: dict[str, list[float]]) -> DataFrame:
    """name, p, and the values below and above the percentile as text: a row for each column and probability."""
    rows = [(c, float(p), *(None if v is None else str(v) for v in x[:2])) for c, ends in neighbours(df, probs).items() for p, x in zip(probs[c], ends)]
    return df.sparkSession.createDataFrame(rows, "name string, p double, lower string, upper string")
