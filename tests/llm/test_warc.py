"""WARC archives: round trips, predicates, skipping, damaged files, and the page query against a plain version."""

import gzip
import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringStartsWith
from pyspark.sql.types import StructType

from sparkclean.llm import queries, warc

BARE = StructType().add("type", "string").add("payload", "binary")


def rows_of(path, tests=(), schema=BARE):
    reader = warc.WarcReader(str(path), schema, 1 << 20)
    assert not list(reader.pushFilters(list(tests)))
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def archive(*records, packed=True):
    parts = [warc.record_bytes([("WARC-Type", t), *headers], body) for t, headers, body in records]
    return b"".join(warc.gzip_member(p) if packed else p for p in parts)


RECORDS = [("warcinfo", [], b"software: x"), ("response", [("WARC-Target-URI", "http://a/1")], b"x" * 300_000), ("revisit", [("WARC-Refers-To", "<urn:1>")], b""),
           ("response", [("WARC-Target-URI", "http://b/2"), ("X-Lang", "de")], b"\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 0\r\n\r\n")]


@pytest.mark.parametrize("packed", [True, False])
def test_records_and_predicates(tmp_path, packed):
    path = tmp_path / "a.warc"
    path.write_bytes(archive(*RECORDS, packed=packed))
    assert [(r["type"], r["payload"]) for r in rows_of(path)] == [(t, b) for t, _, b in RECORDS]
    only = lambda *tests: [r["payload"] for r in rows_of(path, tests)]
    assert only(EqualTo(("type",), "revisit")) == [b""]
    assert only(In(("type",), ("revisit", "warcinfo"))) == [b"software: x", b""]
    assert only(StringStartsWith(("target_uri",), "http://a")) == [b"x" * 300_000]
    assert only(EqualTo(("x-lang",), "de")) == [RECORDS[3][2]] and only(IsNotNull(("X-Lang",))) == [RECORDS[3][2]]
    assert len(only(IsNull(("target_uri",)))) == 2 and len(only(GreaterThan(("length",), 20))) == 2
    assert len(only(Not(EqualTo(("target_uri",), "http://a/1")))) == 1  # unknown where there is none
    assert len(only(Not(EqualNullSafe(("target_uri",), "http://a/1")))) == 3
    if packed:  # the library reads what is written
        assert gzip.decompress(path.read_bytes()) == archive(*RECORDS, packed=False)


def test_other_writers(tmp_path):
    """Members that don't state their length, folded headers, line breaks without a carriage return, several records a member."""
    text = archive(*RECORDS, packed=False)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(archive(r, packed=False)) for r in RECORDS))
    assert [r["payload"] for r in rows_of(tmp_path / "a.warc.gz")] == [b for _, _, b in RECORDS]
    assert [r["payload"] for r in rows_of(tmp_path / "a.warc.gz", [EqualTo(("x-lang",), "de")])] == [RECORDS[3][2]]
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\nwarc-type: resource\nX-Long: a\n b\ncontent-length: 2\n\nhi\n\n" + text)
    schema = StructType().add("x-long", "string").add("length", "long")
    assert rows_of(tmp_path / "b.warc", schema=schema)[0] == {"x-long": "a b", "length": 2}


def test_unwanted_payloads_are_not_decoded(tmp_path, monkeypatch):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(archive(*(("response", [("X-Id", str(k))], os.urandom(1_000_000)) for k in range(20))))
    read = []
    whole = warc.Member._more
    monkeypatch.setattr(warc.Member, "_more", lambda self, n: read.append(len(out := whole(self, n))) or out)
    assert len(rows_of(path, [EqualTo(("x-id",), "7")])) == 1 and sum(read) < 4_000_000
    read.clear()
    assert len(rows_of(path, schema=StructType().add("type", "string"))) == 20 and sum(read) < 4_000_000


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_files(tmp_path, packed):
    whole = archive(*RECORDS, packed=packed)
    for k, data in enumerate((whole[:-40], b"GET / HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", whole[: len(whole) // 2], b"\x1f\x8b\x08\x04\0")):
        path = tmp_path / f"{k}.warc"
        path.write_bytes(data)
        with pytest.raises(warc.WarcError, match=rf"{k}\.warc, record at byte"):
            rows_of(path)


def test_partitions(tmp_path):
    files = [(f"f{k}", size) for k, size in enumerate((10, 10, 200 << 20, 5, 70 << 20))]
    found = warc.planned(files, 64 << 20)
    assert [[n for n, _ in p.files] for p in found] == [["f0", "f1"], ["f2"], ["f3"], ["f4"]]
    assert warc.planned([], 1) == []


def test_spark_round_trip(spark, tmp_path):
    rows = [("response", f"http://a/{k}", bytes([k % 256]) * (k * 37), f"v {k}", None if k % 3 else "de") for k in range(200)]
    df = spark.createDataFrame(rows, "type string, target_uri string, payload binary, `X-Note` string, `X-Lang` string").repartition(4)
    for mode, compression, n in (("append", "gzip", 200), ("append", "none", 400), ("overwrite", "gzip", 200)):
        warc.write_warc(df, f"file://{tmp_path}/w", mode, compression=compression, file_bytes="100000")
        found = warc.read_warc(spark, f"file://{tmp_path}/w", "type string, target_uri string, payload binary, `x-note` string, `x-lang` string", split_bytes="2000000")
        kept = [tuple(r) for r in found.where("type = 'response'").collect()]
        assert sorted(kept) == sorted(rows * (n // 200))
        german = found.where("`x-lang` = 'de' and target_uri like 'http://a/1%'")
        assert german.count() == sum(r[4] == "de" and r[1].startswith("http://a/1") for r in rows) * (n // 200)
        assert "PushedFilters" in german._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not [f for f in os.listdir(tmp_path / "w") if f.startswith("_temporary")]
    warc.write_warc(df.limit(0), f"file://{tmp_path}/empty")
    assert warc.read_warc(spark, f"file://{tmp_path}/empty").count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(4).select(F.lit("response").alias("type"), F.expr("if(id = 3, raise_error('no'), 'x')").alias("payload"))
    with pytest.raises(Exception, match="no"):
        warc.write_warc(bad, f"file://{tmp_path}/w")
    assert not os.path.exists(tmp_path / "w") or not [f for f in os.listdir(tmp_path / "w") if f.endswith("gz")]


def plain(rows):
    same = defaultdict(list)
    for k, _, html in rows:
        data = (html or "").encode()
        if k is not None and len(data) >= 100:
            same[data].append(k)
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        first = min(same.get(data, [k]), default=k) if len(data) >= 100 else k
        again = first != k
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_query_on_odd_pages(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    long = "é<p>" * 40
    rows = [(k, f"http://x/{k}", f"<html>{k % 7} " + "pad " * 30) for k in range(60)] + [(100 + k, "u\r\nv", long) for k in range(50)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", long), (None, "u", "only null " * 20), (None, "u", "only null " * 20),
             (204, "u", "x" * 99), (205, "u", "x" * 99), (206, "u", "y" * 100), (207, "u", "y" * 100), (5, "http://x/5", rows[5][2]), (300, "u", "z" * 2_000_000)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, payload string, n int")
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op11_warc_pages(spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op11_warc_pages(spark, f"{tmp_path}/none").count() == 0
