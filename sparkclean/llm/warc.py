"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions from the sizes of the files, takes predicates on the record type and on any header into the
scan, parses the header block of a record first, and doesn't decode the payload of a record that the predicates or the
asked columns leave out: it is skipped by its length, in compressed archives too where members state theirs.

Writing follows Spark's rules for lost tasks: every attempt writes files of its own in a hidden folder, and only those of
successful tasks are moved into place.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from sparkclean.llm.common import written

#: Columns that stand for headers; every other column but those of CONTENT is the header of its own name.
HEADERS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "content_type": "Content-Type",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "length": "Content-Length"}
CONTENT = ("headers", "http_head", "payload")
SCHEMA = ("type string, record_id string, date string, target_uri string, content_type string, payload_digest string, refers_to string, length long, "
          "headers map<string,string>, http_head string, payload binary")
#: Fixed value: the profile of records that stand for an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of files a partition, what opening a file counts for, bytes of a written file, of a read, of
#: compressed bytes decoded at a time, and of a batch of rows.
SPLIT_BYTES, OPEN_BYTES, FILE_BYTES, READ_BYTES, CODED_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 256 << 20, 1 << 18, 1 << 14, 4 << 20
#: Payloads of fewer bytes are written whole even if they repeat.
LEAST_BYTES = 100
#: A payload that more than this share of all rows have is joined apart; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Longest header block of a record.
MOST_HEADER = 1 << 20


class WarcError(ValueError):
    """What is read is no WARC record."""


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is on a disk that all machines mount."""
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class Bytes:
    """Sequential bytes of a file with a bounded buffer, in which `skip` doesn't read what it leaves out."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held, self.place = file, size, 0, b"", 0

    def peek(self, n: int) -> bytes:
        """The next n bytes, or fewer at the end."""
        have = max(len(self.held) - self.place, 0)
        if have < n and self.at + have < self.size:
            more = self.file.read_at(min(max(n - have, READ_BYTES), self.size - self.at - have), self.at + have)
            self.held, self.place = self.held[self.place :] + more, 0
        return self.held[self.place : self.place + n]

    def skip(self, n: int) -> None:
        self.place, self.at = self.place + n, self.at + n

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(len(out))
        return out


class Member(Bytes):
    """The decoded bytes of one gzip member; `end` goes behind it, without decoding the rest where its length is known."""

    def __init__(self, raw: Bytes):
        self.raw, self.begin, self.held, self.known = raw, raw.at, b"", None
        head = raw.take(10)
        flags = head[3]
        if flags & 4:
            extra = raw.take(struct.unpack("<H", raw.take(2))[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.known = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for flag in (8, 16):  # name and comment
            while flags & flag and raw.take(1) not in (b"\0", b""):
                pass
        raw.skip(2 if flags & 2 else 0)
        self.inflate = zlib.decompressobj(-15)

    def _more(self, n: int) -> bytes:
        """Some more decoded bytes, about n; none at the end of the member."""
        out = b""
        while not out and not self.inflate.eof:
            coded = self.raw.peek(CODED_BYTES)
            if not coded:
                raise WarcError("the file ends inside a compressed record")
            out = self.inflate.decompress(coded, n)
            left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.raw.skip(len(coded) - len(left))
        return out

    def peek(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and (more := self._more(max(n - have, READ_BYTES))):
            parts.append(more)
            have += len(more)
        self.held = b"".join(parts)
        return self.held[:n]

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.held = self._more(READ_BYTES)
            if not self.held:
                return
        self.held = self.held[n:]

    def end(self) -> None:
        if self.known is None:
            while self._more(READ_BYTES):
                pass
            self.raw.skip(8)
        else:
            self.raw.skip(self.begin + self.known - self.raw.at)


def parse_headers(block: bytes) -> dict[str, str]:
    """Header names in lower case and values; a line that begins with white space goes on with the one before."""
    lines = [x.rstrip("\r") for x in block.decode("utf-8", "replace").split("\n")]
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"no WARC record but {block[:40]!r}")
    out, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif line.strip():
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _header_block(source: Bytes) -> bytes | None:
    """Take the header block of the next record with the blank line behind it; None at the end."""
    while source.peek(2)[:1] in (b"\r", b"\n"):
        source.skip(1)
    n = 4096
    while True:
        seen = source.peek(n)
        ends = [i + len(x) for x in (b"\r\n\r\n", b"\n\n") if (i := seen.find(x)) >= 0]
        if ends:
            return source.take(min(ends))
        if not seen:
            return None
        if len(seen) < n or n > MOST_HEADER:
            raise WarcError(f"no end of the header block that begins with {seen[:40]!r}")
        n *= 4


def matches(test: Filter, value) -> bool | None:
    """Whether a header value passes a predicate; None where SQL says unknown."""
    if isinstance(test, Not):
        found = matches(test.child, value)
        return None if found is None else not found
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    if isinstance(test, In):
        return True if value in test.value else None if None in test.value else False
    if test.value is None:
        return None
    compare = {EqualTo: lambda v, x: v == x, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
               GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x}
    return compare[type(test)](value, test.value)


def _column_of(test: Filter) -> tuple[str, ...]:
    return _column_of(test.child) if isinstance(test, Not) else test.attribute


def header_value(headers: dict[str, str], column: str) -> str | int | None:
    value = headers.get(HEADERS.get(column, column).lower())
    return int(value) if column == "length" and value is not None else value


@dataclass
class Files(InputPartition):
    """Files of one partition, with their sizes."""

    files: list[tuple[str, int]]


def planned(files: Iterable[tuple[str, int]], split: int) -> list[Files]:
    """Files in order, gathered into partitions of about `split` bytes; a longer file is a partition of its own."""
    out, total = [], 0
    for name, size in sorted(files):
        if not out or total + size + OPEN_BYTES > split:
            out.append(Files([]))
            total = 0
        out[-1].files.append((name, size))
        total += size + OPEN_BYTES
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split: int):
        self.path, self.schema, self.split, self.tests = path, schema, split, []
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for test in filters:
            column = _column_of(test)
            if len(column) == 1 and column[0] not in CONTENT:
                self.tests.append((column[0], test))
            else:
                yield test

    def partitions(self) -> list[InputPartition]:
        system, path = _located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return planned([(path, info.size)], self.split)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = len(path.rstrip("/"))
        kept = [(x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not any(p[:1] in "._" for p in x.path[hidden:].split("/") if p)]
        return planned(kept, self.split) or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.path)
        rows, held = [], 0
        for name, size in partition.files:
            with system.open_input_file(name) as file:
                for row in self._records(Bytes(file, size), name):
                    rows.append(row)
                    held += 200 + len(row.get("payload") or b"")
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        types = {"bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        arrays = [pa.array([r[c] for r in rows], types.get(kind, pa.string())) for c, kind in self.kinds.items()]
        return pa.RecordBatch.from_arrays(arrays, list(self.kinds))

    def _records(self, raw: Bytes, name: str) -> Iterator[dict]:
        while raw.peek(2):
            begin = raw.at
            try:
                source = Member(raw) if raw.peek(2) == b"\x1f\x8b" else raw
                row = self._record(source)
                if isinstance(source, Member):
                    source.end()
            except (WarcError, zlib.error, struct.error, IndexError) as error:
                raise WarcError(f"{name}, record at byte {begin}: {error}") from error
            if row is not None:
                yield row

    def _record(self, source: Bytes) -> dict | None:
        """The row of the next record, or None if the predicates leave it out; its payload is read only if it is asked for."""
        block = _header_block(source)
        if block is None:
            return None
        headers = parse_headers(block)
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as error:
            raise WarcError("no Content-Length") from error
        wanted = all(matches(test, header_value(headers, column)) for column, test in self.tests)
        if not wanted or not {"payload", "http_head"} & self.kinds.keys():
            if not isinstance(source, Member) or source.known is None:
                source.skip(length)
            return {c: headers if c == "headers" else header_value(headers, c) for c in self.kinds} if wanted else None
        body, head = source.take(length), None
        if len(body) < length:
            raise WarcError("the file ends inside a record")
        if headers.get("content-type", "").startswith("application/http"):
            cut = body.find(b"\r\n\r\n") + 4
            head, body = (body[:cut].decode("utf-8", "replace"), body[cut:]) if cut >= 4 else (body.decode("utf-8", "replace"), b"")
        own = {"headers": headers, "http_head": head, "payload": body}
        return {c: own[c] if c in own else header_value(headers, c) for c in self.kinds}


def record_bytes(headers: Iterable[tuple[str, object]], body: bytes) -> bytes:
    """One WARC record. Headers without a value are left out; white space inside values becomes one space each."""
    lines = [f"{k}: {' '.join(str(v).split())}" for k, v in headers if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own length, so that readers can skip it."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    coded = packer.compress(data) + packer.flush()
    size = 24 + len(coded) + 8
    if size >> 32 or len(data) >> 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + coded + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = struct.pack("<HccHII", 12, b"s", b"l", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + coded + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]):
        self.path, self.names, self.overwrite = path, schema.fieldNames(), overwrite
        self.job, self.date = uuid.uuid4().hex, options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.packed = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def _hidden(self, root: str) -> str:
        return f"{root.rstrip('/')}/_temporary-{self.job}"

    def _coded(self, row: dict) -> bytes:
        head, payload = row.get("http_head"), row.get("payload") or b""
        body = (head or "").encode() + (payload.encode() if isinstance(payload, str) else payload)
        own = {"type": "resource", "date": self.date, "record_id": f"<urn:uuid:{uuid.uuid4()}>"} | {k: v for k, v in row.items() if v is not None}
        data = record_bytes(((HEADERS.get(k, k), v) for k, v in own.items() if k not in CONTENT and k != "length"), body)
        return gzip_member(data) if self.packed else data

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, root = _located(self.path)
        system.create_dir(self._hidden(root), recursive=True)
        part, attempt, names, out, size = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{part:05d}-{len(names):03d}-{attempt}.warc{'.gz' * self.packed}")
                    out, size = system.open_output_stream(f"{self._hidden(root)}/{names[-1]}", compression=None), 0
                    out.write(self._coded({"type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}))
                size += out.write(coded := self._coded(row)) or len(coded)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _located(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if not x.base_name.startswith("_temporary-"):
                    (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{self._hidden(root)}/{name}", f"{root.rstrip('/')}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _located(self.path)
        if system.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            system.delete_dir(self._hidden(root))


class WarcSource(DataSource):
    """Options: path; for reading `split_bytes`; for writing `compression` (gzip or none), `file_bytes`, `date`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], schema, overwrite, dict(self.options))


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """Records of a WARC file or folder, plain or with a gzip member a record; `columns` are a part of SCHEMA in any order.

    Any other column is the header of that name (without regard to case), null where a record has none. Predicates on
    columns other than headers, http_head and payload are applied while headers are read (this turns on
    spark.sql.python.filterPushdown.enabled). Payloads are read only if `columns` has payload or http_head. Of records of
    type application/http, http_head is their HTTP head and payload what follows it. A folder without archives gives no
    rows. Raises WarcError, with file and place, for what is no record or ends early. The path must be one that pyarrow's
    file systems reach from every executor: file (shared), hdfs, s3, gs, abfs.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def write_warc(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write a record per row: columns as in `read_warc`; missing type, date and id become resource, now and a random one.

    Null headers are left out and a null payload is empty. Repeated rows give repeated records; an empty table writes no
    record. A lost task's files are never moved into the folder.
    """
    df.sparkSession.dataSource.register(WarcSource)
    df.write.format("warc").mode(mode).options(**options).save(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Response and revisit records of pages, with their id as header x-page-id and the payload's length as x-payload-length.

    The payload is the page in UTF-8; null is empty. Of rows with equal payloads of at least `least` bytes, those of the
    smallest id are responses and the others revisits of it, without a payload. Smaller payloads, and those that only rows
    without an id have, are all responses. Rows that repeat an id repeat its record. Other columns are not read; an empty
    table gives no rows.

    Equal payloads are found from their digests alone; the few that very many rows have are joined by broadcast, at most
    1 / HOT_SHARE of them, and their copies lose the payload before anything is shuffled.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("c"), F.min("id").alias("first"))
    same = written(same.where("c > 1 and first is not null"), "warc-copies")
    often = F.col("c") > HOT_SHARE * pages.count()
    hot = same.where(often).select("digest", F.col("first").alias("hot_first"))
    rest = same.where(~often).select(F.col("digest").alias("key"), "first")
    known = rows.join(F.broadcast(hot), "digest", "left")
    known = known.withColumn("payload", F.when(F.col("hot_first").isNull() | F.col("hot_first").eqNullSafe(F.col("id")), F.col("payload")))
    # Rows of hot payloads are spread under keys of their own, which nothing matches.
    known = known.withColumn("key", F.when(F.col("hot_first").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("id", "uri").cast("string"))))
    joined = known.join(rest, "key", "left").withColumn("first", F.coalesce("hot_first", "first"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("type"), urn("id").alias("record_id"), F.col("uri").alias("target_uri"),
        F.lit("application/http; msgtype=response").alias("content_type"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn("first")).alias("refers_to"), F.when(again, SAME_PAYLOAD).alias("WARC-Profile"), F.col("id").cast("string").alias("x-page-id"),
        F.col("n").cast("string").alias("x-payload-length"), head.alias("http_head"), F.when(~again, F.col("payload")).alias("payload"))


def archived_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Page id, length and digest of the full payload, record type and refers_to, as read from archives of `page_records`.

    Responses are measured by their payloads; of revisits only the headers are read.
    """
    number = lambda c: F.col(c).cast(id_type)
    urn = F.regexp_extract("refers_to", "^<urn:page:(.*)>$", 1).cast(id_type)
    full = read_warc(spark, path, "type string, `x-page-id` string, payload binary").where("type = 'response'")
    full = full.select(number("x-page-id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.sha2("payload", 256).alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"))
    bare = read_warc(spark, path, "type string, `x-page-id` string, `x-payload-length` string, payload_digest string, refers_to string").where("type = 'revisit'")
    return full.union(bare.select(number("x-page-id"), F.col("x-payload-length").cast("long"), F.regexp_replace("payload_digest", "^sha256:", ""),
                                  "type", urn))
