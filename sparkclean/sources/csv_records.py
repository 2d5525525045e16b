"""CSV files whose quoted fields hold line breaks, read by many tasks.

Whether a line begins inside a quoted field depends on all lines before it. A byte range of a file, as Spark cuts it, is a
map from the state before it to the state behind it; the maps of a file's ranges are composed by a prefix scan, after
which every range knows its state and finds the true ends of its records. Records cut by the end of a range are put
together again from their fragments, of which a range has two at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The rest of a quoted field with its closing quote; two quotes stand for one.
_CLOSING = re.compile(r'(?:[^"]+|"")*+"(?!")')


def inside_after(line: str, inside: bool) -> bool:
    """Is a quoted field still open behind this line? A quote opens a field only where the field begins."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closing = _CLOSING.match(line, at if inside else at + 1)
            if not closing:
                return True
            inside, at = False, closing.end()
        at = line.find(",", at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The lines of each byte range, which come one range after the other and in the order of the file."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        yield key, (r[2] for r in own)


def _maps(lines: DataFrame) -> DataFrame:
    """(file, start, outside, inside): whether a field is open behind each range, if none or one is open before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _ranges(batches):
            outside, inside = False, True
            for line in own:
                if outside == inside:
                    outside = inside = inside_after(line, outside)
                elif '"' in line:
                    outside, inside = inside_after(line, outside), inside_after(line, inside)
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "outside": outside, "inside": inside}])

    return lines.mapInArrow(run, "file string, start long, outside boolean, inside boolean")


def open_before(maps: DataFrame) -> DataFrame:
    """(file, start, open): is a field open where the range begins? A prefix scan over the ranges of each file.

    A map either has one result whatever came before, or keeps the state, or turns it round. So the state is that of the
    last range with one result, turned as often as ranges since then do.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("outside") & ~F.col("inside")).cast("int")
    known = maps.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)) + turns)
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("state"), "turned"))
    last = F.last(fixed, ignorenulls=True).over(before)
    behind = F.coalesce(F.last("turned").over(before), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + behind - F.coalesce(last["turned"], F.lit(0))
    return known.select("file", "start", (F.pmod(state, F.lit(2)) == 1).alias("open"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): the records of the CSV files in `path`, and whether one is the first of its file. Empty ones are left out."""
    lines = _lines(spark, path)
    states = {(r["file"], r["start"]): r["open"] for r in open_before(_maps(lines)).collect()}  # one entry a byte range
    schema = "file string, start long, opens boolean, closes boolean, first boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), own in _ranges(batches):
            if (file, start) not in states:
                raise RuntimeError(f"{file} was cut elsewhere than before; read it again")
            inside, held, out = states[file, start], [], []
            opens, first = not inside, start == 0
            for line in own:
                held.append(line)
                inside = inside_after(line, inside)
                if not inside:
                    text = "\n".join(held)
                    if opens and text.endswith("\r"):  # this file's lines end so, inside of fields too
                        text = text[:-1].replace("\r\n", "\n")
                    if text or not opens:
                        out.append({"file": file, "start": start, "opens": opens, "closes": True, "first": first, "text": text})
                        first = first and not opens
                    opens, held = True, []
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, pa_schema)
                        out = []
            if held:
                out.append({"file": file, "start": start, "opens": opens, "closes": False, "first": first, "text": "\n".join(held)})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa_schema)

    pa_schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("first", pa.bool_()), ("text", pa.string())])
    parts = lines.mapInArrow(run, schema)
    whole = F.col("opens") & F.col("closes")
    order = Window.partitionBy("file").orderBy("start", "opens")
    cut = parts.where(~whole).withColumn("number", F.sum(F.col("opens").cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "opens", "text")))
    joined = cut.groupBy("file", "number").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("record"), F.max("first").alias("first"))
    ends_so = F.when(F.col("record").endswith("\r"), F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n")))
    joined = joined.withColumn("record", F.coalesce(ends_so, "record"))
    return parts.where(whole).select(F.col("text").alias("record"), "first").union(joined.select("record", "first"))


def read_split(spark: SparkSession, path: str, header: DataFrame, options: dict[str, str]) -> DataFrame:
    """The rows of CSV files with quoted line breaks, all columns as text; `header` is what Spark makes of the header row."""
    columns = [f"c{i}" for i in range(len(header.columns))]
    rows = records(spark, path).where(~F.col("first")).select(F.from_csv("record", ", ".join(f"{c} string" for c in columns), options).alias("r"))
    return rows.select(*[F.col(f"r.{c}").alias(n) for c, n in zip(columns, header.columns)])
