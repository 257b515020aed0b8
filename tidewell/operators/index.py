"""A kept inverted index of lexemes: delta-coded postings in segments that are appended run by run and merged.

A posting list holds the ids of one lexeme's posts in one block of ``BLOCK`` ids, as differences in seven-bit groups, so
that the most frequent lexeme is many short lists. A segment is a table of ``(lexeme, block, n, postings)``, sorted by
lexeme, so that a query reads the parts of its files that may hold the lexemes it wants. What counts is the newest row
of the manifest: it names the segments and the largest id that they cover; what a failed run left behind is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions import stem
from tidewell.session import ship

#: Ids of a block, and segments from which on they are merged.
BLOCK, MOST_SEGMENTS = 1 << 20, 8

_SEGMENT = "lexeme string, block long, n long, postings binary"
_MANIFEST = "version long, cursor long, segments array<string>"


def pack(values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of lists that stand end to end and begin at ``firsts``: of each its ascending integers (from
    zero on) as differences in groups of seven bits, the lowest first, from ``offsets[k]`` to ``offsets[k + 1]``."""
    gaps = np.diff(values, prepend=0)
    gaps[firsts] = values[firsts]
    gaps = gaps.astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    starts = ends - size
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint64) << np.uint64(7)
        out[starts[has] + k] = (gaps[has] >> np.uint64(7 * k) & np.uint64(127) | more).astype(np.uint8)
    return out, np.append(starts[firsts], len(out))


def unpack(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, counts)``: the integers of all lists that ``pack`` made ``raw`` and ``offsets`` of, and how many each has."""
    last = raw < 128
    group = np.cumsum(last) - last
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else group
    gaps = np.zeros(int(last.sum()), np.int64)
    np.add.at(gaps, group, (raw & 127).astype(np.int64) << 7 * (np.arange(len(raw)) - starts[group]))
    done = np.concatenate([[0], np.cumsum(last)])
    firsts, counts = done[offsets[:-1]], np.diff(done[offsets])
    sums = np.cumsum(gaps)
    before = np.concatenate([[0], sums])[firsts]
    return sums - np.repeat(before, counts), counts


def packed(values: np.ndarray) -> bytes:
    """One list of ``pack``."""
    return pack(values, np.zeros(min(1, len(values)), np.int64))[0].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The integers of one list."""
    return unpack(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def _binary(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Lists as a column."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists without nulls as ``unpack`` takes it."""
    own = column.cast(pa.large_binary())
    offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(keys, values, firsts)``: values in order within ascending keys, each once, and where each key's begin."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[keep], values[keep]
    return keys, values, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


class Index:
    """The index below ``path``, a folder that driver and executors share; it is made when first updated."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True, block: int = BLOCK) -> None:
        self.spark, self.path, self.stemmed, self.block = spark, path.rstrip("/"), stemmed, block
        ship(spark)

    def _manifest(self) -> tuple[int, int, list[str]]:
        """``(version, cursor, segments)`` as they stand; version 0 where there is no index yet."""
        from pyspark.errors import AnalysisException

        try:
            row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:
            row = None
        return (row["version"], row["cursor"], list(row["segments"])) if row else (0, 0, [])

    def _commit(self, version: int, cursor: int, segments: list[str]) -> None:
        self.spark.createDataFrame([(version, cursor, segments)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    @property
    def cursor(self) -> int:
        """The largest id that the index covers."""
        return self._manifest()[1]

    def _write(self, postings: DataFrame) -> str:
        """A segment of ``(lexeme, block, postings)`` rows, lists of the same lexeme and block joined."""
        name = f"segment-{uuid.uuid4().hex}"

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, counts = unpack(*_bytes(pc.list_flatten(batch.column(2))))
                row = np.repeat(np.asarray(pc.list_parent_indices(batch.column(2))), counts)
                row, ids, firsts = _grouped(row, ids)  # every row has a list, and every list an id
                n = np.diff(np.append(firsts, len(row)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), _binary(*pack(ids, firsts))], ["lexeme", "block", "n", "postings"])

        grouped = postings.groupBy("lexeme", "block").agg(F.collect_list("postings").alias("lists"))
        grouped.mapInArrow(join, _SEGMENT).repartitionByRange("lexeme", "block").sortWithinPartitions("lexeme", "block").write.parquet(f"{self.path}/{name}")
        return name

    def update(self, posts: DataFrame, key: str = "post_id", body: str = "text") -> int:
        """Append a segment of the posts after the cursor, which are all that is read; merge when segments are many.

        Returns the new cursor. Ids of posts only grow and are not below zero.
        """
        version, cursor, segments = self._manifest()
        fresh = posts.filter(F.col(key) > cursor) if version else posts
        top = fresh.agg(F.max(key)).first()[0]
        if top is None:
            return cursor
        block, stemmed = self.block, self.stemmed

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, code, names = stem.coded(batch.column(1), stemmed)
                ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
                parts = int(ids.max(initial=0)) // block + 1
                both, ids, firsts = _grouped(code * parts + ids // block, ids)
                lexemes = pa.array(names, pa.string()).take(pa.array(both[firsts] // parts))
                yield pa.RecordBatch.from_arrays([lexemes, pa.array(both[firsts] % parts), _binary(*pack(ids % block, firsts))], ["lexeme", "block", "postings"])

        rows = fresh.filter(F.col(key).isNotNull()).select(F.col(key).cast("long"), stem.tokens(F.col(body)).alias("tokens"))
        segments = [*segments, self._write(rows.mapInArrow(invert, "lexeme string, block long, postings binary"))]
        self._commit(version + 1, top, segments)
        if len(segments) >= MOST_SEGMENTS:
            self.merge()
        return top

    def merge(self) -> None:
        """All segments as one; the old ones are left to whoever owns the folder."""
        version, cursor, segments = self._manifest()
        if len(segments) > 1:
            self._commit(version + 1, cursor, [self._write(self._read(segments))])

    def _read(self, segments: list[str]) -> DataFrame:
        return self.spark.read.schema(_SEGMENT).parquet(*(f"{self.path}/{s}" for s in segments))

    def postings(self) -> DataFrame:
        """``(lexeme, block, n, postings)`` of all segments; a lexeme and block may have a row in each."""
        segments = self._manifest()[2]
        return self._read(segments) if segments else self.spark.createDataFrame([], _SEGMENT)

    def candidates(self, terms: DataFrame, after: int = 0) -> DataFrame:
        """``(post_id, term_id)`` of the posts after ``after`` that have all lexemes of a term; it may have none, then no posts.

        Only lists of wanted lexemes are read; a term's lists are intersected block by block.
        """
        schema = self.spark.createDataFrame([], "post_id long").schema.add(terms.schema["term_id"])
        found = [self._intersected(own, schema, after) for own in self._wanted(terms)]
        return reduce(DataFrame.unionAll, found) if found else self.spark.createDataFrame([], schema)

    def _wanted(self, terms: DataFrame) -> Iterator[list[tuple]]:
        """``(term_id, need, lexeme)`` of the terms, in parts of bounded size."""
        from tidewell.operators.automaton import parts

        for part in parts(terms):
            own = [(term_id, lexemes) for term_id, name in part if (lexemes := stem.lexemes_of(name, self.stemmed))]
            if own:
                yield [(term_id, len(lexemes), x) for term_id, lexemes in own for x in lexemes]

    def _intersected(self, wanted: list[tuple], schema, after: int) -> DataFrame:
        id_type, block = schema["term_id"].dataType, self.block
        want = self.spark.createDataFrame(wanted, f"term_id {id_type.simpleString()}, need int, lexeme string")
        names = sorted({x for _, _, x in wanted})
        lists = self.postings().filter(F.col("lexeme").between(names[0], names[-1]) & (F.col("block") >= after // block))
        if len(names) <= 1000:
            lists = lists.filter(F.col("lexeme").isin(names))
        # one row for each lexeme of a term in a block, then those of all its lexemes: few and short lists
        each = lists.join(F.broadcast(want), "lexeme").groupBy("term_id", "need", "block", "lexeme").agg(F.collect_list("postings").alias("lists"))
        whole = each.groupBy("term_id", "need", "block").agg(F.collect_list("lists").alias("lists")).filter(F.size("lists") == F.col("need"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, (first, lists) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    sets = sorted((np.unique(np.concatenate([unpacked(x) for x in own])) for own in lists), key=len)
                    ids = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sets) + first * block
                    ids = ids[ids > after] if after else ids
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0).take(pa.array(np.full(len(ids), k)))], ["post_id", "term_id"])

        return whole.select("term_id", "block", "lists").mapInArrow(run, schema)
