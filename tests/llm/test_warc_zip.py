"""ZIP packages of WARC records: round trips, ZIP64, damaged files, odd rows, hot payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from meterlark.llm import warc_zip

SCHEMA = "page_id long, url string, html string, uri string, bytes long, start int"
ODD = [
    (5, "http://a/1", "<p>same</p>", "x", 1, 1), (3, "http://a/2", "<p>same</p>", "x", 1, 1), (3, "http://a/2", "<p>same</p>", "x", 1, 1), (None, "http://a/3", "<p>same</p>", "x", 1, 1), (None, None, "alone é", "x", 1, 1),
    (7, None, None, "x", 1, 1), (6, "", "", "x", 1, 1), (8, "http://a/ä b\r\nWARC-Type: x", "\r\n\r\nWARC/1.1\r\n\r\n", "x", 1, 1), (9, "http://a/9", "x" * 300_000, "x", 1, 1), (2**62, "http://a/9", "PK\x05\x06", "x", 1, 1), (-4, "u", "negative", "x", 1, 1),
]


def plain(rows, least=0):
    out, first = [], {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        body = (rows[i][2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = digest in first and len(body) >= least
        out.append((rows[i][0], len(body), digest, "revisit" if revisit else "response", first[digest] if revisit else None, True))
        first.setdefault(digest, rows[i][0])
    return sorted(out, key=str)


@pytest.fixture
def write(spark, tmp_path):
    def to(rows, partitions=3):
        spark.createDataFrame(rows, SCHEMA).repartition(partitions).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return to


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1], ODD[:2] * 40], ids=["odd", "empty", "one", "copies"])
def test_query_against_plain_python(spark, write, rows):
    df = warc_zip.op13_zip_archives(spark, write(rows))
    assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == plain(rows)


def test_sql_on_odd_rows(spark, write):
    folder = write(ODD)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert sorted(con.execute(warc_zip.OP13_SQL).fetchall(), key=str) == plain(ODD)


def test_packages_roll_and_payloads_come_back(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    packages = warc_zip.write_archives(pages, f"{tmp_path}/w", most_bytes=20_000).cache()
    assert packages.count() > 3 and packages.agg(F.sum("records")).first()[0] == pages.count()
    got = {r.record_id: bytes(r.payload).decode() for r in warc_zip.read_archives(packages).collect()}
    assert sorted(got.values()) == sorted(r.html for r in pages.collect())
    # Any ZIP tool reads a package, and any gzip tool its archive.
    with zipfile.ZipFile(packages.first().uri) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read(warc_zip.DATA)).count(b"WARC/1.1\r\n") == packages.first().records + 1


def test_small_payloads_stay_responses(spark, write, tmp_path):
    pages = spark.read.parquet(write(ODD) + "/pages.parquet")
    records = warc_zip.read_archives(warc_zip.write_archives(pages, f"{tmp_path}/w", least=5), payload=False)
    assert records.where("record_type = 'revisit'").count() == 3 and records.where("payload_bytes = 0 and record_type = 'response'").count() == 2


def test_zip64_directories():
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(70_000):
            z.writestr(zipfile.ZipInfo(f"other/{i}"), b"")
        z.comment = b"PK\x05\x06 is no end here" + bytes(20)
    entries = list(warc_zip.Package(many, len(many.getvalue())).entries())
    assert len(entries) == 70_000 and entries[69_999][0] == "other/69999"
    # Sizes and offsets in a ZIP64 field, the directory's place in the ZIP64 end.
    data, name = b"0123456789", b"archive/x"
    local = struct.pack("<4sHHHHHLLLHH", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
    extra = struct.pack("<HH", 0x5455, 0) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 7)
    central = struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = 7 + len(local)
    end64 = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    end = struct.pack("<4sLQL", b"PK\x06\x07", 0, at + len(central), 1) + struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = b"padding" + local + central + end64 + end
    package = warc_zip.Package(io.BytesIO(whole), len(whole))
    assert list(package.entries()) == [("archive/x", 0, 10, 7)] and package.read(package.start(7), 10) == data


def test_damage_is_told(spark, tmp_path):
    packed = tmp_path / "packed.wacz"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.DATA, b"x" * 100)
    with packed.open("rb") as f, pytest.raises(ValueError, match="compressed"):
        list(warc_zip.ranges(f, packed.stat().st_size))
    outside = tmp_path / "outside.wacz"
    with zipfile.ZipFile(outside, "w") as z:
        z.writestr(warc_zip.DATA, b"x" * 100)
        z.writestr(warc_zip.INDEX, "a 1970 " + json.dumps({"filename": "data.warc.gz", "offset": "90", "length": "11"}))
    with outside.open("rb") as f, pytest.raises(ValueError, match="outside"):
        list(warc_zip.ranges(f, outside.stat().st_size))
    with pytest.raises(ValueError, match="no end"):
        list(warc_zip.Package(io.BytesIO(b"short"), 5).entries())
    record = warc_zip.record_of("response", "<urn:page:1:0>", "1970-01-01T00:00:00Z", None, "A" * 32, b"body", None)
    assert warc_zip._row(warc_zip.parse_record(record), False)[-1] is False  # the digest is not the payload's
    with pytest.raises(ValueError, match="length"):
        warc_zip.parse_record(gzip.compress(gzip.decompress(record) + b"more"))


def test_only_ranges_are_read(spark, sf, tmp_path):
    packages = warc_zip.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), f"{tmp_path}/w")
    uri, size = packages.select("uri", "bytes").first()
    reads = []

    class Spy(io.FileIO):
        def read(self, n=-1):
            reads.append(n)
            return super().read(n)

    with Spy(uri) as f:
        found = list(warc_zip.ranges(f, size))
    data_bytes = sum(n for _, n in found)
    assert found and sum(reads) < size - data_bytes + warc_zip.END_SIZE + warc_zip.COMMENT_MOST + 1000
