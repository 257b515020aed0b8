"""Bloom filters of bounded size, built by Spark and sent along.

Keys are bytes. A filter never denies a key that was put in; its size follows the number of keys up to a bound, beyond
which it grants more keys by chance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewell.session import materialise, ship

#: Bits of a filter for each key, at most in all (as a power of two), and the places that a key marks.
PER_KEY, MOST_BITS, LEAST_BITS, MARKS = 24, 27, 13, 4
_PART = 1 << 16


def _marks(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each of ``hashes``, a row each."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64((1 << bits) - 1) for k in range(MARKS)], axis=1).astype(np.int64)


@dataclass(frozen=True)
class Filter:
    bits: int
    table: np.ndarray

    def has(self, keys: list[bytes]) -> np.ndarray:
        """Of each key whether it may have been put in."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys))
        at = _marks(hashes, self.bits)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)


def build(keys: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """The filter of the binary column ``key``: each task marks its own keys, marks are united part by part.

    Only the filter itself, at most ``2 ** most_bits`` bits, comes to the driver.
    """
    spark = keys.sparkSession
    ship(spark)
    hashed = materialise(keys.select(F.xxhash64("key").alias("h")), "keys")
    n = hashed.count()
    bits = min(max(int(n * PER_KEY).bit_length(), LEAST_BITS), most_bits)
    part = min(_PART, 1 << bits - 3)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            at = _marks(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits).reshape(-1)
            np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for k, own in enumerate(table.reshape(-1, part)):
            if own.any():
                yield _row(k, own)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(part, np.uint8)
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != now:
                    if now is not None:
                        yield _row(now, own)
                    now, own = k, np.zeros(part, np.uint8)
                own = own | np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
        if now is not None:
            yield _row(now, own)

    kind = "part long, marks binary"
    marked = hashed.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(mark, kind)
    united = materialise(marked.repartition("part").sortWithinPartitions("part").mapInArrow(unite, kind), "filter")
    table = np.zeros((1 << bits - 3) // part * part, np.uint8).reshape(-1, part)
    for r in united.collect():
        table[r["part"]] = np.frombuffer(zlib.decompress(bytes(r["marks"])), np.uint8)
    return Filter(bits, table.reshape(-1))


def _row(part: int, own: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["part", "marks"])
