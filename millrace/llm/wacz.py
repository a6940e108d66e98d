"""WARC records in ZIP-packaged archives, written and read by byte ranges.

A package is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (a gzip member for each record), ``indexes/index.cdx``
(a line for each record with its offset and length in the archive),
``pages/pages.jsonl`` and ``datapackage.json``. The reader parses the end of
the file, the ZIP64 locator and directory where they are needed, the central
directory and one local header for each member; then it reads records by range
and inflates each by itself. Nothing is extracted.

Files are reached through ``pyarrow.fs``, so a package can lie on a local,
HDFS or object store. Writers give every attempt a file of its own and hand
its name on only when it is complete, so a task that is repeated or
speculated leaves at most an unlisted file.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_dir

ARCHIVE, INDEX, PAGES, PACKAGE = "archive/data.warc.gz", "indexes/index.cdx", "pages/pages.jsonl", "datapackage.json"
FULL32, FULL16 = 0xFFFFFFFF, 0xFFFF


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path of a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# ------------------------------------------------------------------ writing


class ZipWriter:
    """Stored members, one after another, on a stream that can only be appended to.

    Sizes and checksums follow each member in a data descriptor; ZIP64 fields
    are written where a number needs them, or everywhere if ``zip64``.
    """

    def __init__(self, out: Any, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> None:
        member = self.members[-1]
        member[2] += len(data)
        member[3] = zlib.crc32(data, member[3])
        self._put(data)

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        wide = self.zip64 or size >= FULL32
        self._put(struct.pack("<IIQQ" if wide else "<IIII", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, at, size, crc in self.members:
            extra = b""
            shown = []
            for value in (size, size, at):
                if self.zip64 or value >= FULL32:
                    extra += struct.pack("<Q", value)
                    shown.append(FULL32)
                else:
                    shown.append(value)
            if extra:
                extra = struct.pack("<HH", 1, len(extra)) + extra
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, shown[0], shown[1], len(name), len(extra), 0, 0, 0, 0, shown[2]) + name + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or start >= FULL32 or size >= FULL32 or n >= FULL16:
            where = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, where, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


def warc_record(kind: str, uri: str, payload: bytes, digest: str, length: int, number: int | None, refers_to: int | None) -> bytes:
    """One record. A revisit has headers only; its payload is that of the page it refers to."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number}:{digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if number is not None:
        lines.append(f"X-Page-ID: {number}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class PackageWriter:
    """One package: records are appended, the index and the page list follow at the end."""

    def __init__(self, folder: str):
        self.uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz"
        fs, path = open_fs(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = ZipWriter(self.out)
        self.zip.begin(ARCHIVE)
        self.at, self.index, self.pages, self.sha = 0, [], [], hashlib.sha256()

    def add(self, page: dict[str, Any]) -> None:
        data = gzip_member(warc_record(page["record_type"], page["url"] or "", page["payload"], page["digest"], page["length"], page["page_id"], page["refers_to"]))
        self.zip.write(data)
        self.sha.update(data)
        self.index.append(f"{'-' if page['page_id'] is None else page['page_id']} " + json.dumps({"digest": page["digest"], "offset": self.at, "length": len(data)}))
        self.pages.append(json.dumps({"id": page["page_id"], "url": page["url"] or ""}))
        self.at += len(data)

    def close(self) -> str:
        self.zip.end()
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE, "bytes": self.at, "hash": f"sha256:{self.sha.hexdigest()}"}]}
        for name, text in ((INDEX, "\n".join(self.index)), (PAGES, "\n".join(['{"format": "json-pages-1.0", "id": "pages"}', *self.pages])), (PACKAGE, json.dumps(about))):
            self.zip.begin(name)
            self.zip.write(text.encode())
            self.zip.end()
        self.zip.close()
        self.out.close()
        return self.uri


# ------------------------------------------------------------------ reading


class ZipReader:
    """Stored members of a ZIP file by byte range; ``read(offset, length)`` is all that it needs of the file."""

    def __init__(self, size: int, read: Any):
        self.size, self.read = size, read
        self.members = {name: (at, length, crc) for name, at, length, crc in self._directory()}

    def _directory(self) -> Iterator[tuple[str, int, int, int]]:
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        n, length, start = struct.unpack_from("<HII", tail, end + 10)
        if FULL16 == n or FULL32 in (length, start):
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("a ZIP64 locator is missing")
            record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("a ZIP64 directory record is missing")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
        table, at = self.read(start, length), 0
        for _ in range(n):
            if table[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", table, at + 8)
            crc, packed, plain, names, extras, comment = struct.unpack_from("<IIIHHH", table, at + 16)
            where = struct.unpack_from("<I", table, at + 42)[0]
            name = table[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            extra = table[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                tag, long = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                    plain = next(wide) if plain == FULL32 else plain
                    packed = next(wide) if packed == FULL32 else packed
                    where = next(wide) if where == FULL32 else where
                extra = extra[4 + long :]
            at += 46 + names + extras + comment
            if not name.endswith("/"):
                if method or flags & 1 or packed != plain:
                    raise ValueError(f"{name} is compressed or encrypted; members of a package are stored")
                yield name, where, plain, crc

    def span(self, name: str) -> tuple[int, int]:
        """(offset, length) of a member's bytes in the file; the local header tells where they begin."""
        where, length, _ = self.members[name]
        local = self.read(where, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        names, extras = struct.unpack_from("<HH", local, 26)
        return where + 30 + names + extras, length

    def range(self, name: str, offset: int, length: int) -> bytes:
        at, size = self.span(name)
        if offset < 0 or offset + length > size:
            raise ValueError(f"{name} has {size} bytes")
        return self.read(at + offset, length)

    def whole(self, name: str) -> bytes:
        data = self.range(name, 0, self.members[name][1])
        if zlib.crc32(data) != self.members[name][2]:
            raise ValueError(f"{name} is damaged")
        return data


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one gzipped record."""
    data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def read_package(uri: str, run: int = 1 << 22) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(page_id, headers, payload) of every record that the index of a package lists; records are read in ranges of about ``run`` bytes."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as file:
        package = ZipReader(file.size(), lambda at, n: file.read_at(n, at))
        at, size = package.span(ARCHIVE)
        entries = []
        for line in package.whole(INDEX).decode().splitlines():
            number, _, about = line.partition(" ")
            about = json.loads(about)
            entries.append((about["offset"], about["length"], None if number == "-" else int(number)))
        entries.sort(key=lambda e: e[0])
        held, start = b"", 0
        for offset, length, number in entries:
            if offset + length > size:
                raise ValueError("the index points outside of the archive")
            if offset + length > start + len(held):
                start, held = offset, package.read(at + offset, min(size - offset, max(run, length)))
            yield number, *parse_record(held[offset - start : offset - start + length])


# ------------------------------------------------------------------ operators


def _write(folder: str, most: int):
    schema = pa.schema([("package", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    writer = PackageWriter(folder)
                writer.add(row | {"payload": (row["html"] or "").encode()})
                if writer.at >= most:
                    done.append((writer.close(), len(writer.index)))
                    writer = None
        if writer is not None:
            done.append((writer.close(), len(writer.index)))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], schema=schema)

    return run


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in READ.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows, held = [], 0
            for number, headers, payload in read_package(uri):
                kind, digest, length = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of page {number} in {uri} is damaged")
                refers = headers.get("x-refers-to-page")
                rows.append((number, length, digest, kind, int(refers) if refers else None, headers["warc-target-uri"], payload if kind == "response" else None))
                held += len(payload)
                if held > 8_000_000:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def plan_records(pages: DataFrame, least: int = 1000, salts: int = 16) -> DataFrame:
    """(page_id, digest, length, record_type, refers_to): which page of equal payloads is the response.

    Only digests that occur twice are joined back, each spread over ``salts``
    keys, so a payload that a third of all pages share is no hot key. The html
    itself isn't shuffled here.
    """
    html = F.coalesce("html", F.lit(""))
    narrow = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("length"))
    narrow = settle(narrow, "digests").withColumn("salt", F.coalesce(F.pmod("page_id", F.lit(salts).cast("long")), F.lit(0).cast("long")))
    large = narrow.where(f"length >= {least}")
    repeated = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    later = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("first") > F.col("page_id")))
    return narrow.join(repeated, ["digest", "salt"], "left").select(
        "page_id",
        "digest",
        "length",
        F.when(later, "revisit").otherwise("response").alias("record_type"),
        F.when(later, F.col("first")).alias("refers_to"),
    )


def write_packages(pages: DataFrame, folder: str, least: int = 1000, most: int = 64 << 20) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns (package, records), one row a file.

    The payload is the html in UTF-8; null is empty. Of the pages with equal
    payloads of at least ``least`` bytes the one with the largest page_id is a
    response and the others are revisits without a payload of their own;
    smaller ones are all responses. Repeated rows are written as often as they
    occur (those that share the largest page_id are all responses). Rows
    without a page_id are written without one, as revisits where a page with
    one has their payload. Null urls are empty. Other columns are ignored. An empty table writes no file.

    The html is shuffled once, by page_id, where it meets its plan.
    """
    plan = plan_records(pages, least).dropDuplicates(["page_id", "digest"])
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.sha1(html).alias("digest"))
    same = F.col("f.page_id").eqNullSafe(F.col("p.page_id")) & (F.col("f.digest") == F.col("p.digest"))
    rows = full.alias("f").join(plan.alias("p"), same).select("f.*", "p.length", "p.record_type", "p.refers_to").select("page_id", "url", F.when(F.col("record_type") == "response", F.col("html")).alias("html"), "digest", "length", "record_type", "refers_to")
    return settle(rows.mapInArrow(_write(folder, most), "package string, records long"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """Every record of the packages named in column ``package``: see ``READ`` for the columns.

    ``payload`` is null for revisits; ``payload_bytes`` and ``payload_digest``
    are those of the full payload. Damaged packages raise.
    """
    spark = packages.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism)
    return packages.select("package").distinct().repartition(4 * n, "package").mapInArrow(_read, READ)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to packages and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url)."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/millrace/wacz-{uuid.uuid4().hex}"
    return read_packages(write_packages(pages, folder)).drop("payload")
