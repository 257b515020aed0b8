"""Web-archive records in ZIP packages: writing them, and reading records by range without extraction.

A package has stored (uncompressed) members only: pairs of ``archive/data-N.warc.gz``, in which every record is a
gzip member of its own, and ``indexes/index-N.cdx``, one line a record. The reader finds the end-of-directory record
(ZIP64 too) by reading a file's tail, then the central directory, then the index members, and fetches records
as byte ranges of the package. Files are opened where they lie: local paths directly, others through Arrow's file systems.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm import binfiles
from tidewell.llm.binfiles import RangeFile
from tidewell.session import materialise, scratch, ship, shuffle_partitions

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes of a data member, and of one range read.
MEMBER_BYTES, RANGE_BYTES = 8 << 20, 4 << 20

_LOCAL = struct.Struct("<4sHHHHHIIIHH")
_CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")
_END = struct.Struct("<4sHHHHIIH")
_END64 = struct.Struct("<4sQHHIIQQQQ")
_LOCATOR = struct.Struct("<4sIQI")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF


class ZipWriter:
    """Builds a package of stored members as a sequence of frames that one byte follows each."""

    def __init__(self, gap: int = 1) -> None:
        self.gap, self.at, self.entries = gap, 0, []

    def member(self, name: str, data: bytes) -> bytes:
        raw = name.encode()
        large = len(data) >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        size = _FULL32 if large else len(data)
        frame = _LOCAL.pack(b"PK\3\4", 45, 0x800, 0, 0, 33, zlib.crc32(data), size, size, len(raw), len(extra)) + raw + extra + data
        self.entries.append((raw, zlib.crc32(data), len(data), self.at))
        self.at += len(frame) + self.gap
        return frame

    def close(self) -> bytes:
        """Central directory, ZIP64 and plain end records; the byte that follows is the package's comment."""
        out = bytearray()
        for raw, crc, size, offset in self.entries:
            wide = [v for v in (size, size, offset) if v >= _FULL32]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            short = min(size, _FULL32)
            out += _CENTRAL.pack(b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, min(offset, _FULL32)) + raw + extra
        n, length, start = len(self.entries), len(out), self.at
        out += _END64.pack(b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start) + _LOCATOR.pack(b"PK\6\7", 0, start + length, 1)
        out += _END.pack(b"PK\5\6", 0, 0, min(n, _FULL16), min(n, _FULL16), min(length, _FULL32), min(start, _FULL32), self.gap)
        return bytes(out)


@dataclass(frozen=True)
class Member:
    """A stored member: where its data begins in the package, its length and checksum."""

    name: str
    offset: int
    length: int
    crc: int


def members(file: RangeFile) -> list[Member]:
    """The package's stored members from its central directory; ValueError if it has none or is damaged.

    Compressed members are left out: their records cannot be read by range.
    """
    tail_at = max(0, file.size - (1 << 16) - _END.size)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + _END.size > len(tail) or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
    if at + tail_at >= _LOCATOR.size:
        mark, _, end64, _ = _LOCATOR.unpack(file.read(tail_at + at - _LOCATOR.size, _LOCATOR.size))
        if mark == b"PK\6\7":
            head = _END64.unpack(file.read(end64, _END64.size))
            if head[0] != b"PK\6\6":
                raise ValueError("damaged ZIP64 end record")
            count, length, start = head[7], head[8], head[9]
    directory, found, at = file.read(start, length), [], 0
    for _ in range(count):
        head = _CENTRAL.unpack_from(directory, at)
        if head[0] != b"PK\1\2":
            raise ValueError("damaged central directory")
        method, crc, packed, size, n_name, n_extra, n_comment, offset = head[4], head[7], head[8], head[9], head[10], head[11], head[12], head[16]
        at += _CENTRAL.size
        name, extra = directory[at : at + n_name].decode("utf-8", "replace"), directory[at + n_name : at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        p = 0
        while p + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, p)
            if kind == 1:  # 64-bit values stand in this order for those that do not fit above
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, p + 4))
                size = wide.pop(0) if size == _FULL32 and wide else size
                packed = wide.pop(0) if packed == _FULL32 and wide else packed
                offset = wide.pop(0) if offset == _FULL32 and wide else offset
            p += 4 + width
        if method == 0:
            local = _LOCAL.unpack(file.read(offset, _LOCAL.size))
            if local[0] != b"PK\3\4":
                raise ValueError("damaged local header")
            found.append(Member(name, offset + _LOCAL.size + local[9] + local[10], packed, crc))
    return found


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response and keeps only the head."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c if c.isprintable() and c != " " else "%20" for c in url or "") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """``(record headers, HTTP headers, payload)`` with lower-case names; ValueError for what is no whole record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("no record")
    fields = lambda raw: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}
    own = fields(head)
    block = rest[: int(own["content-length"])]
    if len(block) != int(own["content-length"]):
        raise ValueError("record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, fields(http), payload


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Payload, its length and digest, and refers_to (the first page of equal payload) of every row.

    Only digests that occur more than once are joined back; they are counted with partial sums, and the payload itself
    is shuffled only where that table is too large to send along.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    again = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    out = rows.join(materialise(again, "repeats"), "digest", "left")
    return out.withColumn("refers_to", F.when((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first")))


def write_archives(pages: DataFrame, path: str, member_bytes: int = MEMBER_BYTES) -> None:
    """A package for each partition of ``pages``; a task holds one data member at a time."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, data, index, n = ZipWriter(), bytearray(), [], 0
        frame = lambda *x: pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], ["frame"])

        def flush() -> pa.RecordBatch:
            nonlocal n
            both = frame(package.member(f"archive/data-{n}.warc.gz", bytes(data)), package.member(f"indexes/index-{n}.cdx", "".join(index).encode()))
            data.clear(), index.clear()
            n += 1
            return both

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    raw = gzip.compress(record(row["page_id"], row["url"], row["payload"], row["digest"], row["size"], row["refers_to"]), 1, mtime=0)
                    index.append(f"{'-' if row['page_id'] is None else row['page_id']} {len(data)} {len(raw)} {row['digest']}\n")
                    data += raw
                    if len(data) >= member_bytes:
                        yield flush()
        if data:
            yield flush()
        if package.entries:
            yield frame(package.close())

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "size", "refers_to")
    binfiles.write_frames(rows.mapInArrow(run, "frame binary"), path)


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, offset, lengths)``: byte ranges of adjacent records, from the packages' directories and indexes."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with RangeFile(uri) as file:
                    if not file.size:
                        continue
                    found = {m.name: m for m in members(file)}
                    out: list[tuple[str, int, list[int]]] = []
                    for name, index in found.items():
                        if not name.startswith("indexes/"):
                            continue
                        data = found[name.replace("indexes/index-", "archive/data-").replace(".cdx", ".warc.gz")]
                        raw = file.read(index.offset, index.length)
                        if zlib.crc32(raw) != index.crc:
                            raise ValueError(f"index fails its checksum: {uri}")
                        held, start, total = [], None, 0
                        for line in raw.decode().splitlines():
                            _, offset, length, _ = line.split(" ")
                            start = data.offset + int(offset) if start is None else start
                            held.append(int(length))
                            total += int(length)
                            if total >= range_bytes:
                                out.append((uri, start, held))
                                held, start, total = [], None, 0
                        if held:
                            out.append((uri, start, held))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["path", "offset", "lengths"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return files.mapInArrow(run, "path string, offset long, lengths array<long>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of every record.

    A response's length and digest are those of the payload read; a digest that differs from the record's head
    raises. A revisit has those of its head and a null payload.
    """
    ship(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").rstrip(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with RangeFile(row["path"]) as file:
                    data, at, out = file.read(row["offset"], sum(row["lengths"])), 0, []
                for length in row["lengths"]:
                    own, http, payload = parse(gzip.decompress(data[at : at + length]))
                    at += length
                    digest = own["warc-payload-digest"].removeprefix("sha256:")
                    revisit = own["warc-type"] == "revisit"
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload fails its digest: {own['warc-record-id']}")
                    size = int(http["content-length"]) if revisit else len(payload)
                    out.append((number(own["warc-record-id"]), own["warc-target-uri"], size, digest, own["warc-type"], number(own.get("warc-refers-to")), None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return ranges(spark, path).repartition(shuffle_partitions(spark)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read_back(pages: DataFrame) -> DataFrame:
    """Write the packages of ``pages`` to the shared folder and return what their records say, payloads aside.

    Null html is an empty payload, a null url is about:blank, a null page_id stays null (and refers to the first page
    of an equal payload that has an id). Repeated rows are records of their own; no rows, no records. A very long payload is
    one record, and a range of its own; columns other than page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    path = scratch(spark, "archives")
    write_archives(pages, path)
    return read_records(spark, path).drop("payload", "url")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT page_id, payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS head FROM q WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head < page_id THEN head END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
