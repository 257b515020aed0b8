"""MPEG audio in a media column: parsing it frame by frame, and payloads carried in it without loss.

``probe`` adds to rows with a binary column what the audio in it is: tags (ID3v2, ID3v1, APEv2), the table of a
variable bit rate (Xing or Info with its encoder's extension, VBRI), checksums of frames and of the whole, the exact
number of samples, and the offset of every frame for seeking. Frame headers are followed by their lengths; where none
stands the parser looks for the next two that agree and counts what it passed over. Streams of a free bit rate have no
length in their headers and are passed over.

A payload is carried in the bytes that Layer III leaves to ancillary data: 576 bytes beside the 576 samples of each
frame, which say silence. Frames of ASCII bytes pack seven bits of each and have a lower bit rate, so streams are of
variable bit rate and have a table; frames are protected, the private bit tells the two kinds apart.

Texts, frames and checksums of an Arrow batch are handled together as arrays; only headers are walked one by one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.session import scratch, ship

UNIT = 576
PAD = 255
#: Bit rates in kbit/s of the indexes 1 to 14 by (version 1 or other, layer), and sample rates of version 1: fixed values.
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = (44100, 48000, 32000)
#: Layer II: widths in bits of the allocation of subbands as (width, subbands) runs, by table: fixed values.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}
#: Frames whose bytes are gathered at once.
_SLICE = 2048


@dataclass(frozen=True)
class Header:
    """What the four bytes of a frame's header say."""

    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    private: bool
    mode: int
    extension: int
    samples: int
    length: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.channels == 1 else 32) if self.version == "1" else (9 if self.channels == 1 else 17)


@lru_cache(maxsize=1 << 16)
def header(word: int) -> Header | None:
    """The header that the big-endian ``word`` is, if it is one with a length."""
    version, layer = {0: "2.5", 2: "2", 3: "1"}.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    kbps = BIT_RATES[version == "1", layer][index - 1]
    hertz = SAMPLE_RATES[rate] // {"1": 1, "2": 2, "2.5": 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != "1" else 1152
    pad = word >> 9 & 1
    length = (12_000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    return Header(version, layer, not word >> 16 & 1, kbps, hertz, bool(word >> 8 & 1), word >> 6 & 3, word >> 4 & 3, samples, length)


#: Bits of a header that are the same in all frames of a stream: sync, version, layer, sample rate.
_SAME = 0xFFFE0C00


# checksums ------------------------------------------------------------------------------------------------------------


def _crc_table(reflected: bool) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    c = c if reflected else c << 8
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ 0xA001, c >> 1) if reflected else np.where(c & 0x8000, c << 1 ^ 0x8005, c << 1) & 0xFFFF
    return c.astype(np.uint16)


_FRAME_CRC, _WHOLE_CRC = _crc_table(False), _crc_table(True)


def frame_crc(rows: np.ndarray) -> np.ndarray:
    """The checksum of the protected bytes in each of ``rows``."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = crc << 8 ^ _FRAME_CRC[crc >> 8 ^ column]
    return crc


def whole_crc(rows: np.ndarray, start: int = 0) -> np.ndarray:
    """The reflected checksum of each of ``rows``, which that of a stream is put together from."""
    crc = np.full(len(rows), start, np.uint16)
    for column in rows.T:
        crc = crc >> 8 ^ _WHOLE_CRC[(crc ^ column) & 0xFF]
    return crc


@lru_cache(maxsize=256)
def _shift(length: int) -> np.ndarray:
    """What each checksum becomes after ``length`` zero bytes; it is linear, so 16 of them make the table."""
    basis = 1 << np.arange(16, dtype=np.uint32)
    for _ in range(length):
        basis = basis >> 8 ^ _WHOLE_CRC[basis & 0xFF]
    table = np.zeros(1, np.uint32)
    for b in basis:
        table = np.concatenate([table, table ^ b])
    return table


def joined_crc(crcs: np.ndarray, lengths: np.ndarray) -> int:
    """The checksum of adjacent pieces from each piece's own."""
    crc = 0
    for own, length in zip(crcs.tolist(), lengths.tolist()):
        crc = int(_shift(length)[crc]) ^ own
    return crc


def _layer2_bits(raw: bytes, at: int, h: Header) -> int | None:
    """Bits after the checksum that it protects in a Layer II frame: allocation and scale factor selection."""
    per_channel = h.kbps // h.channels
    if h.version != "1":
        name = "low"
    elif per_channel <= 48:
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if per_channel <= 80 or h.rate == 48000 else "b"
    widths = [w for w, n in ALLOCATION[name] for _ in range(n)]
    bound = min(4 * (h.extension + 1) if h.mode == 1 else 32, len(widths))
    bits, total = int.from_bytes(raw[at : at + 64].ljust(64, b"\0"), "big"), 0
    chosen = 0
    for k, width in enumerate(widths):
        for _ in range(h.channels if k < bound else 1):
            if bits >> 512 - total - width & (1 << width) - 1:
                chosen += 1 if k < bound else h.channels
            total += width
    return total + 2 * chosen


def _bit_crc(raw: bytes, bits: int) -> int:
    crc = 0xFFFF
    for k in range(bits):
        bit = raw[k >> 3] >> 7 - (k & 7) & 1
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


# tags and tables ------------------------------------------------------------------------------------------------------


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def id3v2(raw: bytes) -> tuple[int, dict[str, str]]:
    """``(length, text frames)`` of the tag that ``raw`` begins with; ``(0, {})`` if it begins with none."""
    if len(raw) < 10 or raw[:3] != b"ID3" or max(raw[6:10]) > 127:
        return 0, {}
    size, version, flags = _syncsafe(raw[6:10]), raw[3], raw[5]
    body, tags = raw[10 : 10 + size], {}
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and len(body) >= 4:
        at = _syncsafe(body) if version == 4 else int.from_bytes(body[:4], "big") + 4
    while version > 2 and at + 10 <= len(body) and body[at]:
        name, length = body[at : at + 4].decode("latin-1"), _syncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        data = body[at + 10 : at + 10 + length]
        at += 10 + length
        if name.startswith("T") and data:
            text = data[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(data[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0")
            tags[f"TXXX:{key}" if name == "TXXX" else name] = value if name == "TXXX" else text
    return 10 + size + (10 if flags & 0x10 else 0), tags


def tail_tags(raw: bytes) -> tuple[int, dict[str, str]]:
    """``(length, values)`` of the ID3v1 and APEv2 tags that ``raw`` ends with."""
    cut, tags = 0, {}
    if raw[-128:-125] == b"TAG" and len(raw) >= 128:
        own = raw[-128:]
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := own[a:b].split(b"\0")[0].decode("latin-1").strip():
                tags[name] = text
        cut = 128
    end = len(raw) - cut
    foot = raw[max(0, end - 32) : end]
    if len(foot) == 32 and foot[:8] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", foot[12:24])
        if 32 <= size <= end:
            at = end - size
            for _ in range(count):
                length, _ = struct.unpack_from("<II", raw, at)
                stop = raw.index(b"\0", at + 8)
                tags[raw[at + 8 : stop].decode("latin-1")] = raw[stop + 1 : stop + 1 + length].decode("utf-8", "replace")
                at = stop + 1 + length
            cut += min(end, size + (32 if flags >> 31 else 0))
    return cut, tags


@dataclass
class Table:
    """A stream's table: what it says of frames and bytes, its seek points, and its encoder's extension."""

    kind: str
    frames: int | None = None
    bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    delay: int = 0
    padding: int = 0
    whole_crc: int | None = None
    #: The frame up to its own checksum, which it ends with.
    own: bytes = b""


def table_of(frame: bytes, h: Header) -> Table | None:
    """The table in a stream's first frame, if it is one."""
    for at in (4 + h.side, 6 + h.side):
        if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            found, flags = Table(frame[at : at + 4].decode()), int.from_bytes(frame[at + 4 : at + 8], "big")
            p = at + 8
            if flags & 1:
                found.frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 2:
                found.bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                found.toc, p = list(frame[p : p + 100]), p + 100
            p += 4 if flags & 8 else 0
            if len(frame) >= p + 36 and frame[p : p + 9].strip(b"\0"):
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                found.delay, found.padding = both >> 12, both & 0xFFF
                found.whole_crc = int.from_bytes(frame[p + 32 : p + 34], "big")
                found.own = frame[: p + 36]
            return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, delay, _, size, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return Table("VBRI", frames, size, toc, delay)
    return None


# streams --------------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    """The audio of one value: headers' words and places of its frames, table frame aside; what was passed over."""

    tags: dict[str, str]
    table: Table | None
    words: list[int]
    offsets: list[int]
    skipped: int
    resyncs: int


def _agrees(raw: bytes, at: int, end: int, first: int | None) -> bool:
    """Whether a frame of the stream begins at ``at`` and the next one, or the stream's end, follows it."""
    word = int.from_bytes(raw[at : at + 4], "big")
    h = header(word)
    if h is None or at + h.length > end or first is not None and (word ^ first) & _SAME:
        return False
    after = at + h.length
    follower = int.from_bytes(raw[after : after + 4], "big")
    return after == end or header(follower) is not None and (word ^ follower) & _SAME == 0


def _next(raw: bytes, at: int, stop: int, end: int, first: int | None) -> int:
    """The next place before ``stop`` where frames agree, else ``stop``."""
    at = raw.find(b"\xff", at, stop)
    while at >= 0 and not _agrees(raw, at, end, first):
        at = raw.find(b"\xff", at + 1, stop)
    return stop if at < 0 else at


def walk(raw: bytes) -> Stream:
    """Follow the frames of ``raw`` from header to header.

    A frame that no frame follows counts, unless two that agree begin inside it: then its header was chance.
    """
    start, tags = id3v2(raw)
    cut, more = tail_tags(raw)
    end = max(len(raw) - cut, start)
    words: list[int] = []
    offsets: list[int] = []
    at, first, skipped, resyncs = start, None, 0, 0
    while at + 4 <= end:
        word = int.from_bytes(raw[at : at + 4], "big")
        h = header(word)
        good = h is not None and at + h.length <= end and (first is None or (word ^ first) & _SAME == 0)
        found = end
        if not good or not _agrees(raw, at, end, first):
            found = _next(raw, at + 1, at + h.length if good else end, end, first)
            good = good and first is not None and found == at + h.length
        if good:
            words.append(word)
            offsets.append(at)
            first = word
            at += h.length
            continue
        if h is not None and found < end and found == at + h.length:  # nothing begins inside what was no frame
            found = _next(raw, found, end, end, first)
        resyncs += first is not None and found < end
        skipped += found - at
        at = found
    skipped += end - at
    table = table_of(raw[offsets[0] : offsets[0] + header(words[0]).length], header(words[0])) if words else None
    if table:
        words, offsets = words[1:], offsets[1:]
    return Stream(more | tags, table, words, offsets, skipped, resyncs)


@dataclass
class Batch:
    """The streams of a batch of values, with all frames as arrays over the joined bytes."""

    raw: np.ndarray
    streams: list[Stream]
    #: First frame of each stream, and one more.
    first: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, values: list[bytes]) -> Batch:
        streams = [walk(v) for v in values]
        starts = np.cumsum([0, *map(len, values)])
        first = np.cumsum([0, *(len(s.offsets) for s in streams)])
        words = np.array([w for s in streams for w in s.words], np.int64)
        offsets = np.array([o + int(at) for s, at in zip(streams, starts) for o in s.offsets], np.int64)
        kinds, which = np.unique(words, return_inverse=True)
        lengths = np.array([header(int(w)).length for w in kinds], np.int64)[which] if len(words) else np.zeros(0, np.int64)
        return cls(np.frombuffer(b"".join(values), np.uint8), streams, first, offsets, lengths, words, starts)

    def rows(self, which: np.ndarray, begin: int, length: int) -> np.ndarray:
        """``length`` bytes from ``begin`` of each of the frames ``which``."""
        return self.raw[self.offsets[which][:, None] + np.arange(begin, begin + length)]

    def slices(self, keep: np.ndarray) -> Iterator[np.ndarray]:
        found = np.flatnonzero(keep)
        for at in range(0, len(found), _SLICE):
            yield found[at : at + _SLICE]

    def protected(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each frame whether it has a checksum, and whether that is wrong."""
        has, wrong = np.zeros(len(self.words), bool), np.zeros(len(self.words), bool)
        for word in np.unique(self.words):
            h = header(int(word))
            if not h.protected:
                continue
            for own in self.slices(self.words == word):
                has[own] = True
                stored = self.rows(own, 4, 2).astype(np.uint16)
                if h.layer == 2:
                    for k in own.tolist():
                        raw = self.raw[self.offsets[k] : self.offsets[k] + self.lengths[k]].tobytes()
                        wrong[k] = _bit_crc(raw[2:4] + raw[6:], 16 + _layer2_bits(raw, 6, h)) != int.from_bytes(raw[4:6], "big")
                    continue
                size = h.side if h.layer == 3 else (32 + (4 * (h.extension + 1) if h.mode == 1 else 32 if h.mode < 3 else 0)) // 2
                crc = frame_crc(np.hstack([self.rows(own, 2, 2), self.rows(own, 6, size)]))
                wrong[own] = crc != stored[:, 0] << 8 | stored[:, 1]
        return has, wrong

    def whole_crcs(self) -> np.ndarray:
        """The whole checksum of each frame's bytes."""
        out = np.zeros(len(self.words), np.uint16)
        for length in np.unique(self.lengths):
            for own in self.slices(self.lengths == length):
                out[own] = whole_crc(self.rows(own, 0, int(length)))
        return out

    def table_checks(self) -> list[bool | None]:
        """Of each stream whether its table's frame agrees with its own checksum; None without one."""
        own = [s.table.own if s.table else b"" for s in self.streams]
        out: list[bool | None] = [None] * len(own)
        for length in {len(x) for x in own if x}:
            which = [k for k, x in enumerate(own) if len(x) == length]
            rows = np.frombuffer(b"".join(own[k] for k in which), np.uint8).reshape(len(which), length)
            ok = whole_crc(rows[:, :-2]) == (rows[:, -2].astype(np.uint16) << 8 | rows[:, -1])
            for k, good in zip(which, ok.tolist()):
                out[k] = good
        return out

    def reports(self) -> list[dict]:
        """What ``probe`` returns of each stream."""
        has, wrong = self.protected()
        tables = self.table_checks()
        tabled = any(s.table and s.table.whole_crc is not None for s in self.streams)
        crcs = self.whole_crcs() if tabled else np.zeros(0, np.uint16)
        out = []
        for k, s in enumerate(self.streams):
            a, b = int(self.first[k]), int(self.first[k + 1])
            h, t = header(s.words[0]) if s.words else None, s.table
            kbps = [header(w).kbps for w in set(s.words)]
            delay, padding = (t.delay, t.padding) if t else (0, 0)
            samples = max(0, (b - a) * h.samples - delay - padding) if h else 0
            out.append(
                {
                    "version": h and h.version,
                    "layer": h and h.layer,
                    "sample_rate": h and h.rate,
                    "channels": h and h.channels,
                    "least_kbps": min(kbps, default=None),
                    "most_kbps": max(kbps, default=None),
                    "frames": b - a,
                    "samples": samples,
                    "seconds": samples / h.rate if h else 0.0,
                    "table": t and t.kind,
                    "table_frames": t and t.frames,
                    "table_bytes": t and t.bytes,
                    "toc": t.toc if t else [],
                    "tags": list(s.tags.items()),
                    "crc_checked": int(has[a:b].sum()),
                    "crc_failed": int(wrong[a:b].sum()),
                    "table_ok": tables[k],
                    "whole_ok": None if not t or t.whole_crc is None else joined_crc(crcs[a:b], self.lengths[a:b]) == t.whole_crc,
                    "skipped": s.skipped,
                    "resyncs": s.resyncs,
                    "offsets": s.offsets,
                }
            )
        return out


_REPORT = (
    "version string, layer int, sample_rate int, channels int, least_kbps int, most_kbps int, frames long, samples long, seconds double, "
    "table string, table_frames long, table_bytes long, toc array<int>, tags map<string, string>, crc_checked long, crc_failed long, "
    "table_ok boolean, whole_ok boolean, skipped long, resyncs int, offsets array<long>"
)


def _few(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``most`` bytes of a column (one longer value makes a part of its own)."""
    at, held = 0, 0
    for k, value in enumerate(batch.column(column)):
        size = len(value.as_buffer()) if value.is_valid else 0
        if k > at and held + size > most:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    yield batch.slice(at)


def probe(rows: DataFrame, column: str = "media", into: str = "audio") -> DataFrame:
    """``rows`` with the struct ``into``, which says what the binary ``column`` holds; null for null.

    ``samples`` is exact (frames less the delay and padding that the table names) and ``seconds`` follows from it;
    ``offsets`` has the place of every frame that carries sound. Values without any frame have none. A column ``into``
    that is there already is replaced.
    """
    ship(rows.sparkSession)
    kept = rows.drop(into)
    place = kept.columns.index(column)
    report = T.StructType.fromDDL(_REPORT)
    schema, kind = T.StructType([*kept.schema.fields, T.StructField(into, report)]), to_arrow_type(report)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch, place) if batch.num_rows else ():
                values = part.column(place).to_pylist()
                found = iter(Batch.of([v for v in values if v is not None]).reports())
                own = pa.array([None if v is None else next(found) for v in values], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, own], [*part.schema.names, into])

    return kept.mapInArrow(run, schema)


# carrying payloads ----------------------------------------------------------------------------------------------------


def _header_word(kbps: int, private: bool) -> int:
    """A protected mono Layer III frame of version 2 at 16 kHz."""
    return 0xFFF20000 | (BIT_RATES[False, 3].index(kbps) + 1) << 12 | 2 << 10 | private << 8 | 3 << 6


#: Frames with seven bits of each byte, and with whole bytes; the table's frame.
PACKED, PLAIN, TABLE = _header_word(128, True), _header_word(144, False), _header_word(48, False)
_BODY = 4 + 2 + 9


def _head(word: int) -> bytes:
    """Header, checksum and the side information of a silent frame."""
    raw = word.to_bytes(4, "big")
    crc = int(frame_crc(np.frombuffer(raw[2:] + bytes(9), np.uint8)[None, :])[0])
    return raw + crc.to_bytes(2, "big") + bytes(9)


def packed(rows: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), UNIT, 8)[:, :, 1:]
    return np.packbits(bits.reshape(len(rows), UNIT * 7), axis=1)


def unpacked(rows: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(rows), UNIT, 8), np.uint8)
    bits[:, :, 1:] = np.unpackbits(rows, axis=1).reshape(len(rows), UNIT, 7)
    return np.packbits(bits.reshape(len(rows), UNIT * 8), axis=1)


def _table_frames(lengths: list[np.ndarray], crcs: list[int]) -> list[bytes]:
    """The frame with the table of each stream: frames, bytes, seek points and the encoder's extension."""
    head, size, frames = _head(TABLE), header(TABLE).length, []
    for own, crc in zip(lengths, crcs):
        total = size + int(own.sum())
        before = size + np.concatenate([[0], np.cumsum(own)])
        toc = np.minimum(before[np.arange(100) * len(own) // 100] * 256 // total, 255).astype(np.uint8).tobytes()
        counts, short = struct.pack(">III", 7, len(own), min(total, 0xFFFFFFFF)), struct.pack(">IH", min(total, 0xFFFFFFFF), crc)
        frames.append(head + b"Xing" + counts + toc + b"tidewell1" + bytes(19) + short)
    rows = np.frombuffer(b"".join(frames), np.uint8).reshape(len(frames), -1)
    return [(f + struct.pack(">H", crc)).ljust(size, b"\0") for f, crc in zip(frames, whole_crc(rows).tolist())]


def _tag(n_bytes: int, seconds: float) -> bytes:
    frames = b""
    for name, text in ((b"TLEN", f"{round(seconds * 1000)}"), (b"TXXX", f"bytes\0{n_bytes}")):
        body = b"\x03" + text.encode()
        frames += name + bytes([0, 0, 0, len(body), 0, 0]) + body
    return b"ID3\x04\0\0" + bytes([0, 0, 0, len(frames)]) + frames


def encoded(payloads: list[bytes]) -> list[bytes]:
    """A stream for each of ``payloads``."""
    counts = [max(1, -(-len(p) // UNIT)) for p in payloads]
    first = np.cumsum([0, *counts])
    rows = np.full((int(first[-1]), UNIT), PAD, np.uint8)
    flat = rows.reshape(-1)
    for p, at in zip(payloads, first):
        flat[at * UNIT : at * UNIT + len(p)] = np.frombuffer(p, np.uint8)
    ascii_ = (rows < 128).all(axis=1)
    frames: list[bytes] = [b""] * len(rows)
    crcs = np.zeros(len(rows), np.uint16)
    for word, keep in ((PACKED, ascii_), (PLAIN, ~ascii_)):
        length, head, found = header(word).length, np.frombuffer(_head(word), np.uint8), np.flatnonzero(keep)
        for at in range(0, len(found), _SLICE):
            own = found[at : at + _SLICE]
            body = packed(rows[own]) if word == PACKED else rows[own]
            out = np.zeros((len(own), length), np.uint8)
            out[:, :_BODY] = head
            out[:, _BODY : _BODY + body.shape[1]] = body
            crcs[own] = whole_crc(out)
            raw = out.tobytes()
            for k, i in enumerate(own.tolist()):
                frames[i] = raw[k * length : (k + 1) * length]
    lengths = np.where(ascii_, header(PACKED).length, header(PLAIN).length)
    ranges = [(int(a), int(b)) for a, b in zip(first[:-1], first[1:])]
    tables = _table_frames([lengths[a:b] for a, b in ranges], [joined_crc(crcs[a:b], lengths[a:b]) for a, b in ranges])
    h = header(PLAIN)
    return [b"".join([_tag(len(p), (b - a) * h.samples / h.rate), t, *frames[a:b]]) for p, t, (a, b) in zip(payloads, tables, ranges)]


def carried(batch: Batch) -> list[bytes]:
    """The padded payload of each stream of ``batch``; ValueError for frames of another kind."""
    rows = np.zeros((len(batch.words), UNIT), np.uint8)
    for word, size, plain in ((PACKED, UNIT * 7 // 8, unpacked), (PLAIN, UNIT, lambda x: x)):
        for own in batch.slices(batch.words == word):
            rows[own] = plain(batch.rows(own, _BODY, size))
    if not np.isin(batch.words, (PACKED, PLAIN)).all():
        raise ValueError("no frames of a payload")
    raw = rows.tobytes()
    return [raw[int(a) * UNIT : int(b) * UNIT] for a, b in zip(batch.first[:-1], batch.first[1:])]


def store(docs: DataFrame, path: str) -> None:
    """Write ``(doc_id, media)`` of the texts of ``docs`` as a table at ``path``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch, 1) if batch.num_rows else ():
                media = encoded(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    texts.mapInArrow(run, "doc_id long, media binary").write.option("compression", "zstd").parquet(path)


def _feature(r: dict) -> str:
    """What was found, as one line; the seek offsets by their checksum."""
    seek = zlib.crc32(np.array(r["offsets"], "<i8").tobytes())
    return (
        f"mpeg{r['version']} layer{r['layer']} {r['sample_rate']}Hz {r['channels']}ch {r['least_kbps']}-{r['most_kbps']}kbps "
        f"frames={r['frames']} samples={r['samples']} {r['table']}={r['table_frames']}/{r['table_bytes']} toc={zlib.crc32(bytes(r['toc']))} "
        f"crc={r['crc_checked'] - r['crc_failed']}/{r['crc_checked']} table_ok={r['table_ok']} whole_ok={r['whole_ok']} "
        f"skipped={r['skipped']} resyncs={r['resyncs']} seek={seek}"
    )


def read_back(media: DataFrame) -> DataFrame:
    """Payload digests, those of the stored form and features of ``(doc_id, media)``, from the stored bytes alone."""
    ship(media.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _few(batch, 1) if batch.num_rows else ():
                values = part.column(1).to_pylist()
                found = Batch.of(values)
                out = []
                for own, raw, r in zip(carried(found), values, found.reports()):
                    n_bytes = int(dict(r["tags"])["TXXX:bytes"])
                    out.append((n_bytes, len(own), sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(raw), sha256(raw).hexdigest(), _feature(r)))
                columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def store_and_read_back(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` as MPEG audio in the shared folder and return what reading it back gives.

    Null and empty texts are one unit of padding; very long texts are one value, as texts are in Spark; repeated rows are rows
    of their own with equal values; an empty table gives an empty one. Columns other than doc_id and text are ignored.
    """
    path = scratch(docs.sparkSession, "media")
    store(docs, path)
    return read_back(docs.sparkSession.read.schema("doc_id long, media binary").parquet(path))
