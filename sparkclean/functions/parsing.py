"""Text to number and text to timestamp, as Column expressions that give NULL on failure."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency signs, and what is removed from currency text.
CURRENCY_SIGNS = "[$€£¥₹₽]"
CURRENCY_STRIP = r"[$€£¥₹₽]\s*|,(?=\d{3})"

# Spark's cast takes '1d' and '5f' as numbers, so the text form is checked before the cast.
_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"


def try_num(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def try_long(text: Column) -> Column:
    return F.when(text.rlike(_INTEGER), F.trim(text).try_cast("bigint"))


def try_bool(text: Column) -> Column:
    return F.when(text.isin("True", "TRUE", "true"), F.lit(True)).when(
        text.isin("False", "FALSE", "false"), F.lit(False)
    )


def has_currency(text: Column) -> Column:
    return text.rlike(CURRENCY_SIGNS)


def currency_to_num(text: Column) -> Column:
    return try_num(F.trim(F.regexp_replace(text, CURRENCY_STRIP, "")))


# A text's shape has 9 for each digit and a for each letter. Formats of days, tried in order; slash and dash dates are
# month-first, day-first where that is impossible. Years of two digits count from 1969 on, as strptime has it.
_DAY_FORMATS = (
    ("yyyy-M-d",), ("yyyy/M/d",), ("M/d/yyyy", "d/M/yyyy"), ("M-d-yyyy", "d-M-yyyy"), ("M/d/yy", "d/M/yy"), ("MMM d[,] yyyy",), ("MMMM d[,] yyyy",),
    ("d MMM yyyy", "d-MMM-yyyy"), ("d MMMM yyyy",), ("yyyyMMdd",))
# The shapes that each part of a format reads.
_PART_SHAPES = {"yyyy": ["9999"], "yy": ["99"], "MM": ["99"], "dd": ["99"], "M": ["9", "99"], "d": ["9", "99"], "MMM": ["aaa"],
                "MMMM": ["a" * n for n in range(4, 10)], "[,]": ["", ","]}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _shapes(pattern: str) -> list[str]:
    """All shapes of the texts that a format reads."""
    parts = re.findall(r"y+|M+|d+|\[,\]|.", pattern)
    return sorted({"".join(x) for x in product(*(_PART_SHAPES.get(p, [p]) for p in parts))})


# Shape -> formats; the first format that has a shape reads it.
_SHAPE_FORMATS: dict[str, tuple[str, ...]] = {}
for _formats in _DAY_FORMATS:
    for _format in _formats:
        for _shape in _shapes(_format):
            _SHAPE_FORMATS.setdefault(_shape, ())
            _SHAPE_FORMATS[_shape] += (_format,)
# Days and times that Spark's own cast reads, as they are.
_CAST_SHAPES = ("9999-99-99 99:99:99", "9999-99-99 99:99")
# What a date can begin with; keeps the costly parts away from other text.
_LOOKS_LIKE_DATE = r"(?i)^(\d{1,4}[-/]\d{1,2}[-/]\d|[a-z]{3,9}\.?,? [a-z0-9]+|\d{1,2}[ -][a-z]{3}|(19|20)\d{6}$)"
# Eight digits are a day only in these centuries.
_PACKED_DAY = r"^(19|20)\d{2}(0[1-9]|1[0-2])\d{2}$"
# Names of days, which may stand before a date.
_DAY_NAMES = r"(?:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?:day)?"
_PARTS = (
    rf"(?i)^(?:{_DAY_NAMES}\.?,? )?(.*?[^ T])"
    r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(?: ?([ap]m)| ?(z|[+-]\d{2}:?\d{2}))?)?$")


def _recent(day: Column) -> Column:
    """A day read from a year of two digits, which Spark puts into 2000-2099."""
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def _shape(text: Column) -> Column:
    return F.translate(text, _LETTERS + "0123456789", "a" * len(_LETTERS) + "9" * 10)


def _day(text: Column) -> Column:
    """Day of a text without a time: its shape says which formats can read it, mostly a single one."""
    shape, by_formats = _shape(text), {}
    for own, formats in _SHAPE_FORMATS.items():
        by_formats.setdefault(formats, []).append(own)
    out = F.lit(None).cast("date")
    for formats, shapes in reversed(by_formats.items()):
        days = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
        found = F.coalesce(*[_recent(d) if "yyyy" not in f else d for d, f in zip(days, formats)])
        if formats == ("yyyyMMdd",):
            found = F.when(text.rlike(_PACKED_DAY), found)
        out = F.when(shape.isin(*shapes), found).otherwise(out)
    return out


def try_ts(text: Column) -> Column:
    """Timestamp of text in any of the accepted date formats, else NULL.

    A day, with or without a day name, and after a space or T a time: hours of a day or a.m. and p.m., seconds,
    fractions (cut at microseconds) and a zone. Bare years, bare times, 'now' and 'today' are not dates: their meaning
    would depend on the clock. A text whose whole shape is that of a day, or that a cast reads, is parsed once; only
    others are taken apart.
    """
    t = F.trim(text)
    shape = _shape(t)
    parts = F.split(F.regexp_replace(t, _PARTS, "\x01".join(f"${k}" for k in range(1, 8))), "\x01")
    # A lambda binds the parts, so they are found once however often they are used.
    apart = F.when(t.rlike(_LOOKS_LIKE_DATE), F.get(F.transform(F.array(parts), _at), F.lit(0)))
    return F.when(shape.isin(*_SHAPE_FORMATS), _day(t).cast("timestamp")).when(shape.isin(*_CAST_SHAPES), t.try_cast("timestamp")).otherwise(apart)


def _at(parts: Column) -> Column:
    day, hour, minute, second, fraction, noon, zone = (F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(7))
    hours = F.nullif(hour, F.lit("")).cast("int")
    hours = F.when(noon == "", hours).when(hours.between(1, 12), hours % 12 + F.when(F.lower(noon) == "pm", 12).otherwise(0))
    clock = F.concat(F.lpad(hours.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":"), F.when(second == "", "00").otherwise(second),
                     F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0"), F.upper(zone))
    found = _day(day)
    return F.when(hour == "", found.cast("timestamp")).otherwise(F.concat(found.cast("string"), F.lit(" "), clock).try_cast("timestamp"))


# Strptime directives and the matching datetime pattern letters; of numbers the letter for one digit or
# more, and the width that a number next to another one has.
_DIRECTIVES = {
    "Y": ("yyyy", 4), "m": ("M", 2), "d": ("d", 2), "H": ("H", 2), "M": ("m", 2), "S": ("s", 2), "b": ("MMM", 0),
    "B": ("MMMM", 0), "y": ("yy", 2), "p": ("a", 0), "I": ("h", 2), "f": ("SSSSSS", 0), "z": ("XX", 0), "j": ("D", 3),
}
_DAY_DIRECTIVES = {"a", "A"}


def _split_format(strptime_format: str) -> list[str]:
    """Directives with their percent sign, and single other characters."""
    out, chars = [], iter(strptime_format)
    for ch in chars:
        out.append(ch + next(chars, "") if ch == "%" else ch)
    return out


def java_pattern(strptime_format: str) -> str:
    """Translate a strptime format to Spark's pattern; an unknown directive raises ValueError.

    Names of days stand for nothing: `parse_with` takes them out of the text.
    """
    parts = _split_format(strptime_format)

    def is_number(k: int) -> bool:
        return 0 <= k < len(parts) and bool(_DIRECTIVES.get(parts[k][1:], ("", 0))[1]) and parts[k][0] == "%"

    out = []
    for k, part in enumerate(parts):
        if part[0] == "%" and part != "%%":
            if part[1:] in _DAY_DIRECTIVES:
                continue
            if part[1:] not in _DIRECTIVES:
                raise ValueError(f"unsupported directive '{part}' in date format '{strptime_format}'")
            letters, width = _DIRECTIVES[part[1:]]
            out.append(letters[0] * width if width and (is_number(k - 1) or is_number(k + 1)) else letters)
        elif part == "'":
            out.append("''")
        elif part.isalpha() or part in "[]{}#":
            out.append(f"'{part}'")
        else:
            out.append(part[-1])
    return "".join(out)


def parse_with(text: Column, strptime_format: str) -> Column:
    """Timestamp of text in a strptime format, else NULL. Numbers may leave out leading zeros next to a delimiter."""
    parts = _split_format(strptime_format)
    if any(p[0] == "%" and p[1:] in _DAY_DIRECTIVES for p in parts):
        text = F.when(text.rlike(rf"(?i)\b{_DAY_NAMES}\b"), F.regexp_replace(text, rf"(?i)\b{_DAY_NAMES}\b", ""))
    found = F.try_to_timestamp(text, F.lit(java_pattern(strptime_format)))
    if "%y" in parts:
        found = F.when(F.year(found) >= 2069, F.add_months(found, -1200).cast("timestamp") + (found - F.date_trunc("day", found))).otherwise(found)
    return found
