"""Web archives in ZIP packages: written as WARC records, read back by byte ranges.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip
member per record), ``indexes/index.cdxj`` (a line per record with its offset and length in the
archive) and ``datapackage.json``. A reader takes the central directory from the end of the file, with
its ZIP64 form, then the index, and then only the ranges of the records it wants; nothing is unpacked.

Paths are URIs of a store that all executors reach (``spark.checkpoint.dir`` in the query); workers open
them with Arrow's filesystems. A package gets a name of its own in each attempt of a task, and a package
counts only if the table of packages, which Spark commits, names it: tasks that run twice leave files
that nothing reads.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, shared_folder

DATA, INDEX, INFO = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
# Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE, COMMENT_MOST = 30, 46, 22, 56, 20, 65_535
FULL16, FULL32, STORED, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 0, 1
#: Bytes that one range read of neighbouring records takes, or of a directory or index.
READ = 4 << 20
RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to_id string, sound boolean"


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# Reading a package


class Package:
    """Directory and members of a ZIP file, by range reads of a seekable file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or start + length > self.size:
            raise ValueError(f"range {start}+{length} lies outside a file of {self.size} bytes")
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"{len(data)} bytes at {start} instead of {length}")
        return data

    def _end(self) -> tuple[int, int, int]:
        """(offset, size, entries) of the central directory."""
        tail = self.read(max(0, self.size - END_SIZE - COMMENT_MOST), min(self.size, END_SIZE + COMMENT_MOST))
        at = tail.rfind(END)
        # The signature may stand in the comment: the true one's comment ends the file.
        while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        entries, size, offset = struct.unpack_from("<HLL", tail, at + 10)
        if FULL16 not in (entries,) and FULL32 not in (size, offset):
            return offset, size, entries
        place = self.size - len(tail) + at - LOCATOR64_SIZE
        locator = self.read(place, LOCATOR64_SIZE)
        if locator[:4] != LOCATOR64:
            return offset, size, entries
        end = self.read(struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
        if end[:4] != END64:
            raise ValueError("the ZIP64 locator points to no ZIP64 directory end")
        entries, size, offset = struct.unpack_from("<QQQ", end, 32)
        return offset, size, entries

    def entries(self) -> Iterator[tuple[str, int, int, int]]:
        """(name, method, stored bytes, offset of the local header) of each member, in chunks of the directory."""
        start, size, left = self._end()
        data, at, stop = b"", 0, start + size
        while left:
            if len(data) - at < CENTRAL_SIZE + 3 * FULL16 and start < stop:
                data, at = data[at:] + self.read(start, step := min(READ, stop - start)), 0
                start += step
            if data[at : at + 4] != CENTRAL:
                raise ValueError("a central directory entry has no signature")
            method, = struct.unpack_from("<H", data, at + 10)
            packed, full, n, extra, comment = struct.unpack_from("<LLHHH", data, at + 20)
            offset, = struct.unpack_from("<L", data, at + 42)
            name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n].decode("utf-8", "replace")
            more = data[at + CENTRAL_SIZE + n : at + CENTRAL_SIZE + n + extra]
            while len(more) >= 4:
                kind, length = struct.unpack_from("<HH", more)
                if kind == EXTRA64:  # the fields that are full here, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", more, 4))
                    full = next(values) if full == FULL32 else full
                    packed = next(values) if packed == FULL32 else packed
                    offset = next(values) if offset == FULL32 else offset
                more = more[4 + length :]
            yield name, method, packed, offset
            at += CENTRAL_SIZE + n + extra + comment
            left -= 1

    def start(self, offset: int) -> int:
        """Where the data of the member with this local header begin."""
        header = self.read(offset, LOCAL_SIZE)
        if header[:4] != LOCAL:
            raise ValueError("a local header has no signature")
        name, extra = struct.unpack_from("<HH", header, 26)
        return offset + LOCAL_SIZE + name + extra

    def lines(self, start: int, length: int) -> Iterator[bytes]:
        rest = b""
        for at in range(start, start + length, READ):
            *whole, rest = (rest + self.read(at, min(READ, start + length - at))).split(b"\n")
            yield from whole
        if rest:
            yield rest


def ranges(file, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) in the package of every record that its indexes name."""
    package, found = Package(file, size), {}
    for name, method, stored, offset in package.entries():
        if name.startswith(("archive/", "indexes/")) and not name.endswith("/"):
            if method != STORED:
                raise ValueError(f"{name} is compressed, so its records have no ranges")
            found[name] = (package.start(offset), stored)
    for name, (start, stored) in found.items():
        if not name.startswith("indexes/"):
            continue
        for line in package.lines(start, stored):
            if b"{" not in line:
                continue
            entry = json.loads(line[line.index(b"{") :])
            base, whole = found[f"archive/{entry['filename']}"]
            at, length = int(entry["offset"]), int(entry["length"])
            if at + length > whole:
                raise ValueError(f"a record of {name} lies outside its archive")
            yield base + at, length


def parse_record(data: bytes) -> dict:
    """Fields of one gzip member with one record: lower-case header names, ``block``, for HTTP also ``payload``."""
    raw = zlib.decompressobj(31).decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than it says")
    out = fields | {"block": rest[:length]}
    if fields.get("content-type", "").startswith("application/http"):
        head, _, out["payload"] = out["block"].partition(b"\r\n\r\n")
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
        out["http-length"] = int(http["content-length"])
    return out


def _row(record: dict, payload: bool) -> tuple:
    digest = record.get("warc-payload-digest", "").removeprefix("sha1:")
    body, n = record.get("payload", b""), record.get("http-length", 0)
    sound = True
    if record["warc-type"] == "response":
        sound, digest, n = sha1_base32(body) == digest and len(body) == n, sha1_base32(body), len(body)
    row = (record["warc-record-id"], record["warc-type"], record.get("warc-target-uri"), digest, n, record.get("warc-refers-to"), sound)
    return (*row, body) if payload else row


def read_archives(packages: DataFrame, payload: bool = True) -> DataFrame:
    """The response and revisit records of packages (uri, bytes): ``RECORDS``, and the payload if wanted.

    ``payload_digest`` and ``payload_bytes`` are those of the bytes read, for revisits those of the
    payload they refer to, as their headers give them; ``sound`` is false where a response's payload
    differs from its headers. Damaged packages and records raise ValueError.
    """
    spark = packages.sparkSession
    n, total = packages.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, spark.sparkContext.defaultParallelism)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                store, path = _open(uri)
                rows: list = []
                with store.open_input_file(path) as file:
                    for found in ranges(file, file.size()):
                        rows.append((uri, *found))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["uri", "start", "length"])
                            rows = []
                yield pd.DataFrame(rows, columns=["uri", "start", "length"])

    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * payload

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file, out, held = None, None, [], 0
        for batch in batches:
            for run in _runs(batch):
                if run[0][0] != uri:
                    uri = run[0][0]
                    store, path = _open(uri)
                    file = store.open_input_file(path)
                low, high = run[0][1], run[-1][1] + run[-1][2]
                data = Package(file, file.size()).read(low, high - low)
                for _, start, length in run:
                    record = parse_record(data[start - low : start - low + length])
                    if record["warc-type"] in ("response", "revisit"):
                        out.append(_row(record, payload))
                        held += len(record["block"]) if payload else 100
                if held > READ:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    found = packages.select("uri").repartition(max(1, min(n, 4 * parts + n // 16))).mapInPandas(locate, "uri string, start long, length long")
    dealt = found.repartitionByRange(max(parts, total // (32 << 20)), "uri", "start").sortWithinPartitions("uri", "start")
    return dealt.mapInPandas(records, RECORDS + (", payload binary" if payload else ""))


def _runs(batch: pd.DataFrame) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbouring records of a package, at most ``READ`` bytes together, or one record."""
    run: list = []
    for row in zip(batch["uri"], batch["start"].tolist(), batch["length"].tolist(), strict=True):
        if run and (row[0] != run[0][0] or row[1] != run[-1][1] + run[-1][2] or row[1] + row[2] - run[0][1] > READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


# Writing packages


def _header(value: str) -> str:
    """A header's value without control characters: they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record_of(kind: str, record_id: str, date: str, uri: str | None, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with its HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_header(uri)}"] if uri is not None else []
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Writer:
    """One package under construction on an output stream."""

    def __init__(self, stream):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.bytes, self.index = 0, []
        info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:info>\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(packer.compress(info) + packer.flush())

    def _put(self, data: bytes) -> None:
        self.data.write(data)
        self.bytes += len(data)

    def add(self, data: bytes, uri: str | None, date: str) -> None:
        entry = {"url": uri, "filename": DATA.split("/")[1], "offset": str(self.bytes), "length": str(len(data))}
        self.index.append(f"{_header(uri or '-')} {date} {json.dumps(entry)}")
        self._put(data)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.index)) + "\n")
        self.zip.writestr(zipfile.ZipInfo(INFO), json.dumps({"profile": "data-package", "records": len(self.index), "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, most_bytes: int = 256 << 20, most_records: int = 100_000, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row to packages in ``folder``; returns them as (uri, bytes, records), as committed there.

    The payload is the body in UTF-8 (null: empty). Of rows with equal payloads of at least ``least``
    bytes the one of the smallest id (null last; of repeated rows one) is a response, the others revisit
    it; smaller payloads are all responses. The record id is ``<urn:page:ID:ROW>``, with ``-`` for a null
    id and the row's place in the input, which tells repeated rows apart.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"), F.sha1(body).alias("_sha1"),
        F.octet_length(body).alias("_bytes"), F.monotonically_increasing_id().alias("_row"),
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("first")
    groups = rows.where(F.col("_bytes") >= least).groupBy("_sha1").agg(first, F.count(F.lit(1)).alias("_group")).where("_group > 1")
    decided = groups.select("_sha1", F.col("first.i").alias("_first_id"), F.col("first.r").alias("_first_row"), "_group")
    # The page's rows meet only digests that occur more than once; those of hot payloads don't shuffle by digest.
    found = lookup(rows, decided, "_sha1", "_group", rows.count(), "_row")
    found = found.withColumn("_revisit", (F.col("_bytes") >= least) & F.col("_first_row").isNotNull() & (F.col("_first_row") != F.col("_row")))

    def named(i, row) -> str:
        return f"<urn:page:{'-' if pd.isna(i) else int(i)}:{int(row)}>"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, writer, k, done = TaskContext.get().partitionId(), None, 0, []
        with contextlib.ExitStack() as stack:
            for batch in batches:
                for i, url, body, sha1, row, first_id, first_row, revisit in batch.itertuples(index=False):
                    if writer is None:
                        uri = f"{folder}/part-{part:05d}-{k:04d}-{uuid.uuid4().hex}.wacz"
                        store, path = _open(uri)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        stream = stack.enter_context(store.open_output_stream(path))
                        writer, k = _Writer(stream), k + 1
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    other = named(first_id, first_row) if revisit else None
                    url = None if pd.isna(url) else url
                    writer.add(record_of("revisit" if revisit else "response", named(i, row), date, url, digest, bytes(body), other), url, date)
                    if writer.bytes >= most_bytes or len(writer.index) >= most_records:
                        done.append(_closed(uri, writer, stream))
                        writer = None
            if writer:
                done.append(_closed(uri, writer, stream))
        yield pd.DataFrame(done, columns=["uri", "bytes", "records"])

    columns = ["_id", "_url", "_body", "_sha1", "_row", "_first_id", "_first_row", "_revisit"]
    # Ids as text: pandas would turn a column with nulls into floats.
    texts = [F.col(c).cast("string").alias(c) if c in ("_id", "_first_id", "_first_row", "_row") else F.col(c) for c in columns]
    found.select(*texts).mapInPandas(write, "uri string, bytes long, records long").write.parquet(f"{folder}/packages")
    return pages.sparkSession.read.parquet(f"{folder}/packages")


def _closed(uri: str, writer: _Writer, stream: io.RawIOBase) -> tuple[str, int, int]:
    writer.close()
    size = stream.tell()
    stream.close()
    return uri, size, len(writer.index)


def op13_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record that was written to a ZIP package and read back.

    A null html is an empty payload, as is an empty one, and both revisit the first of them; a null
    page_id is the largest and refers_to is null where the response's own is; repeated rows are records
    of their own, of which one is the response; an empty table gives no rows.
    """
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(write_archives(pages, folder), payload=False)
    page = "^<urn:page:(\\d+|-\\d+):"
    return records.select(
        F.regexp_extract("record_id", page, 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to_id", page, 1).try_cast("long").alias("refers_to"), "sound",
    )


_DIGEST = "".join(
    f", substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(hex, {5 * (i // 4) + 1}, 5)) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31), 1)" for i in range(32)
)[2:]

OP13_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT row_number() OVER () AS row, page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p
), g AS (
  SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, row) AS nth, first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, row) AS first_id FROM d
)
SELECT page_id, payload_bytes, concat({_DIGEST}) AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN first_id END AS refers_to, true AS sound FROM g
"""
