"""Collocations: frequent phrases by count-min sketches and an exact second pass, scored and subsumed.

The first pass counts all runs of words in a count-min sketch per task; the sketches are added up cell by cell. A
sketch never counts too little, so a phrase whose cells do not all reach the least count cannot be frequent. The second pass
counts exactly, by words, the phrases that the merged sketch lets through: whatever else passes is dropped by its
exact count, so the result does not depend on the sketch. Counters stop at ``FULL``, which is all that the test needs.

The sketch is the only thing sent along: ``ROWS`` rows of at most ``2 ** MOST_BITS`` bytes. Its width follows the size of
the texts; beyond the largest width more phrases pass the test and are counted exactly, and nothing else changes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.session import materialise, ship

LEAST_COUNT, LONGEST, TOP = 10, 3, 2000
#: Rows of the sketch, and the bits of its width at least and at most.
ROWS, LEAST_BITS, MOST_BITS = 2, 16, 25
#: Counters are bytes: a cell that reaches this stays there.
FULL = 255
#: Words that are counted together; bytes of a sketch's parts; input tasks' worth of texts for one sketch at most.
_GROUP, _PART, _SPLITS = 1 << 20, 1 << 16, 64
#: Buckets that each language's phrases are ranked in first.
_RANKED = 256
#: A longer phrase subsumes what it contains where it has this share (in hundredths) of its occurrences.
SHARE = 50

_BREAKS = b".,;:!?\x0b\x0c\r"


class Words:
    """Texts of one or more languages as codes of (language, word), with -1 between pieces."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        """Forget all words; codes are dealt anew."""
        self.codes: dict[bytes, dict[bytes, int]] = {}
        self.names: list[tuple[bytes, bytes]] = []
        self.hashes, self.hashed = np.zeros(1 << 12, np.uint64), 0
        self.parts: list[np.ndarray] = []
        self.totals: Counter[bytes] = Counter()
        self.n = 0

    def add(self, lang: bytes, text: bytes) -> None:
        text = text.lower()  # of bytes: A-Z only
        for mark in _BREAKS:
            text = text.replace(bytes([mark]), b"\n")
        words = text.replace(b"\t", b" ").replace(b"\n", b" \n ").split(b" ")
        known = self.codes.setdefault(lang, {b"": -2, b"\n": -1})
        for w in set(words):
            if w not in known:
                known[w] = len(self.names)
                self.names.append((lang, w))
        own = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        self.parts += [own[own > -2], np.full(1, -1, np.int32)]
        self.totals[lang] += int((own >= 0).sum())
        self.n += len(words)

    def flat(self) -> np.ndarray:
        """All codes since the last call."""
        codes = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        self.parts, self.n, self.totals = [], 0, Counter()
        return codes

    def hash_of(self, codes: np.ndarray) -> np.ndarray:
        """The hash of each code's language and word; it is the same in every task."""
        if len(self.names) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(2 * len(self.names) - len(self.hashes), np.uint64)])
        for k in range(self.hashed, len(self.names)):
            self.hashes[k] = xxhash.xxh64_intdigest(b"\n".join(self.names[k]))
        self.hashed = len(self.names)
        return self.hashes[codes]


def runs(words: Words, codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(size, starts, hashes)`` of all runs of one to ``longest`` words within pieces."""
    own = words.hash_of(np.maximum(codes, 0))
    starts = np.flatnonzero(codes >= 0)
    hashes = own[starts]
    for size in range(1, longest + 1):
        if size > 1:
            ends = starts + (size - 1)
            fits = ends < len(codes)
            fits[fits] = codes[ends[fits]] >= 0
            starts, hashes = starts[fits], hashes[fits]
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + own[starts + (size - 1)]
            hashes ^= hashes >> np.uint64(29)
        yield size, starts, hashes


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = hashes + np.uint64(row) * ((hashes >> np.uint64(32)) | np.uint64(1))
    return (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[np.ndarray, Counter[bytes]]]:
    """Codes of about ``_GROUP`` words at a time, and how many words of each language they are.

    Between groups the words are forgotten once they are many.
    """
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            words.add(lang.as_py(), text.as_py())
            if words.n >= _GROUP:
                totals = words.totals
                yield words.flat(), totals
                if len(words.names) > 2 * _GROUP:
                    words.clear()
    if words.n:
        totals = words.totals
        yield words.flat(), totals


def sketch(texts: DataFrame, bits: int, tasks: int, longest: int = LONGEST) -> np.ndarray:
    """The merged sketch, ``ROWS`` by ``2 ** bits`` counters, of all runs of the ``(lang, text)`` bytes of ``texts``."""
    part = min(_PART, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = np.zeros((ROWS, 1 << bits), np.uint8), Words()
        for codes, _ in _groups(batches, words):
            hashes = np.concatenate([h for _, _, h in runs(words, codes, longest)])
            for row in range(ROWS):
                at, n = np.unique(cells(hashes, row, bits), return_counts=True)
                table[row, at] = np.minimum(table[row, at] + n, FULL)
        for k, own in enumerate(table.reshape(-1, part)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["part", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([zlib.compress(sums.astype(np.uint8).tobytes(), 1)], pa.binary())], ["part", "cells"])

        now, sums = None, np.zeros(part, np.uint16)
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now:
                    if now is not None:
                        yield done()
                    now, sums = k, np.zeros(part, np.uint16)
                sums = np.minimum(sums + np.frombuffer(zlib.decompress(raw.as_py()), np.uint8), FULL)
        if now is not None:
            yield done()

    kind = "part long, cells binary"
    own = texts.coalesce(tasks).mapInArrow(count, kind)
    merged = materialise(own.repartition("part").sortWithinPartitions("part").mapInArrow(merge, kind), "sketch")
    table = np.zeros((ROWS << bits) // part * part, np.uint8).reshape(-1, part)
    for r in merged.collect():  # a sketch at most, whatever the input
        table[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["cells"])), np.uint8)
    return table.reshape(ROWS, 1 << bits)


def frequent(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, bits: int | None = None) -> DataFrame:
    """``(lang, size, phrase, f)``: every run of 1 to ``longest`` words that occurs ``least`` times or more in its language.

    Rows of size 0 hold the number of words of each language. ``bits`` sets the sketch's width (otherwise by the size
    of the texts); it changes what is counted exactly, never the result.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(round(np.log2(max(size, 1) / 16)), LEAST_BITS), MOST_BITS) if bits is None else bits
    tasks = max(spark.sparkContext.defaultParallelism, size // (_SPLITS << 27))
    shared = spark.sparkContext.broadcast(sketch(texts, bits, tasks, longest))
    least_cell = min(least, FULL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = shared.value, Words()
        for codes, totals in _groups(batches, words):
            names, out = words.names, (list(totals), [0] * len(totals), [b""] * len(totals), list(totals.values()))
            for size, starts, hashes in runs(words, codes, longest):
                passes = np.ones(len(hashes), bool)
                for row in range(ROWS):
                    passes &= table[row, cells(hashes, row, bits)] >= least_cell
                at = starts[passes]
                key = codes[at].astype(np.int64)
                for k in range(1, size):  # a run's words as one number, exactly
                    key = np.unique(key, return_inverse=True)[1] << 32 | codes[at + k]
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                for start in at[first].tolist():
                    own = [names[c] for c in codes[start : start + size].tolist()]
                    out[0].append(own[0][0])
                    out[2].append(b" ".join([w for _, w in own]))
                out[1].extend([size] * len(n))
                out[3].extend(n.tolist())
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["lang", "size", "phrase", "f"])

    found = texts.mapInArrow(count, "lang binary, size int, phrase binary, f long")
    sums = found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("size") == 0))
    return materialise(sums.select(F.col("lang").cast("string"), "size", F.col("phrase").cast("string"), "f"), "frequent")


def mine(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, share: int = SHARE, top: int = TOP, bits: int | None = None) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of its lowest-scoring cut, n the words of its language. Products are computed
    as decimals of 38 digits, which hold them up to counts of 10^15. Null texts are empty and null languages ``und``;
    empty tables give an empty result; repeated rows count again; very long texts are counted whole, within a piece runs
    reach over any distance in it; equal scores stand by count, then by phrase. Columns other than lang and text are ignored.
    """
    counted = frequent(docs, least, longest, bits)
    phrases, totals = counted.filter("size > 0"), counted.filter("size = 0").select("lang", F.col("f").alias("n"))
    own = phrases.filter("size > 1").withColumnRenamed("f", "a")

    words = F.split("phrase", " ")
    cut = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.withColumns({"left": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))  # noqa: E731
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"  # noqa: E731
    cut = cut.withColumn("score", F.expr(f"(({wide('a')} * {wide('a')}) * 1000000BD) div ({wide('l')} * {wide('r')})"))
    scored = cut.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    place = F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))
    inner = own.filter("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("at", place)
    inner = inner.select("lang", F.array_join(F.slice(words, F.col("at"), F.col("m")), " ").alias("phrase"), F.col("a").alias("longer"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))

    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(_RANKED)).alias("bucket"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?

]')), '[^ 	]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), g AS (
  SELECT lang, size, x, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[k : k + size - 1], ' ') AS x
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM p, (SELECT unnest(range(1, {LONGEST} + 1)) AS size) WHERE len(w) >= size))
  GROUP BY lang, size, x
), c AS (SELECT lang, size, x, f AS a, string_split(x, ' ') AS w FROM g WHERE size > 1 AND f >= {LEAST_COUNT}),
cuts AS (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (
  SELECT c.lang, c.x, c.a, k, h.f AS l, t.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score
  FROM cuts c JOIN g h ON h.lang = c.lang AND h.x = c.head JOIN g t ON t.lang = c.lang AND t.x = c.tail
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, x, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[j : j + m - 1], ' ') AS x, a
    FROM (SELECT *, unnest(range(1, size - m + 2)) AS j FROM (SELECT *, unnest(range(2, size)) AS m FROM c)))
  GROUP BY lang, x
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
ranked AS (
  SELECT b.lang, b.x AS phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.x) AS rank
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.x = b.x WHERE longer IS NULL OR 100 * longer < {SHARE} * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
