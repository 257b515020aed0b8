"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are majority votes over XXH64 hashes of word shingles. Distinct fingerprints are brought together
by a pigeonhole argument: of ``BLOCKS`` bit blocks at least ``BLOCKS - radius`` agree between any two fingerprints
within the radius, so every combination of that many blocks is a join key and no link is lost; there are the more blocks,
and so the longer keys, the more fingerprints there are, so that groups do not grow with the corpus. Rows of a key are
compared block against block: bit planes are stored vertically (one word holds one bit of 64 fingerprints), many
distances advance together in carry-save counters, and a block is abandoned once every lane exceeds the radius.
A task emits a spanning forest of what it links, never all pairs; keys with many rows are cut into chunks whose
pairs are compared in different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.llm.components import connected_components
from tidewell.session import materialise, ship, shuffle_partitions

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Rows of one key that a task compares with as many others at most; larger keys are dealt over chunk pairs.
CHUNK = 2048
#: Queries compared at once with the lanes of a block.
TILE = 128
#: Hashes counted at once; longer documents are counted piece by piece.
PIECE = 1 << 17

_BYTES = np.uint64(0x0101010101010101)


def shingle_digests(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> list[bytes]:
    """XXH64 (big-endian bytes) of every run of ``shingle`` words, repeats included; of all words if there are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return []
    h, join = xxhash.xxh64_digest, b" ".join
    if len(words) <= shingle:
        return [h(join(words), seed)]
    return [h(join(run), seed) for run in zip(*(words[k:] for k in range(shingle)))]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of consecutive runs of ``hashes``; bit set where over half of a run has it.

    Eight byte-wide counters share a word, so runs are cut into pieces of at most 255 hashes.
    """
    n = len(lengths)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    run = lengths[some]
    pieces = -(-run // 255)
    first = np.cumsum(pieces) - pieces
    offset = np.cumsum(run) - run
    starts = np.repeat(offset, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    counts = np.empty((8, len(some), 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _BYTES, starts)
        counts[k] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    bits = 2 * counts > run[None, :, None]
    for k in range(8):
        for byte in range(8):
            out[some] |= bits[k, :, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of texts; null and wordless texts have fingerprint 0."""
    out = np.zeros(len(texts), np.uint64)
    held, lengths, rows = [], [], []

    def flush() -> None:
        if rows:
            out[rows] = majority(np.frombuffer(b"".join(held), ">u8").astype(np.uint64), np.array(lengths, np.int64))
        held.clear(), lengths.clear(), rows.clear()

    for k, text in enumerate(texts):
        digests = shingle_digests(text, shingle, seed)
        held.extend(digests), lengths.append(len(digests)), rows.append(k)
        if len(held) >= PIECE:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` of every row of ``docs``; fp is the fingerprint's 64 bits as a long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                fps = fingerprints_of(texts.slice(at, 512).to_pylist(), shingle, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Vertical form: ``[64, words]``, bit ``j`` of word ``w`` of plane ``b`` is bit ``b`` of value ``64 w + j``."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near_lanes(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes within ``radius`` of each query as packed words ``[queries, words]``.

    Three planes at a time pass a full adder; its sum and carry ripple into vertical counters, and a lane whose
    count would pass the counters' range is latched as far. Lanes past the last value are compared as zeros.
    """
    width = (radius + 1).bit_length()
    shape = (len(queries), planes.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(width)]
    far = np.zeros(shape, np.uint64)
    masks = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))

    def add(carry: np.ndarray, level: int) -> None:
        for k in range(level, width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        np.bitwise_or(far, carry, out=far)

    def over() -> np.ndarray:
        """Lanes whose counter holds more than the radius: a bitwise comparison from the highest counter down."""
        above, equal = far.copy(), ~far
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return above

    full = ~np.uint64(0)
    for b in range(0, 63, 3):
        x, y, z = (planes[b + i][None, :] ^ masks[:, b + i, None] for i in range(3))
        xy = x ^ y
        add(xy ^ z, 0)
        add((x & y) | (xy & z), 1)
        if b in (21, 30, 39, 48) and np.all(over() == full):
            return np.zeros(shape, np.uint64)
    add(planes[63][None, :] ^ masks[:, 63, None], 0)
    return ~over()


def hits_by_tile(values: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, later rows within the radius)`` of rows that have some, in order.

    ``ends[i]`` is one past the last row of row i's group. The planes of all rows are stored once; the lanes of a tile are the
    words of the planes from its first row to the end of its last row's group.
    """
    planes = bit_planes(values)
    for top in range(0, len(values), TILE):
        bottom = min(top + TILE, len(values))
        stop, word = int(ends[bottom - 1]), top // 64
        found = near_lanes(planes[:, word : -(-stop // 64)], values[top:bottom], radius)
        hits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, top - 64 * word : stop - 64 * word]
        for i in range(bottom - top):
            hits[i, : i + 1] = 0
        for i in np.flatnonzero(hits.any(axis=1)):
            yield top + int(i), top + np.flatnonzero(hits[i])


def forest(values: np.ndarray, nodes: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest over all links found in ``values``.

    ``values`` are sorted by group; ``ends[i]`` is one past the last row of row i's group. Links found across groups are
    true links as well.
    """
    label = np.arange(len(values))
    for i, near in hits_by_tile(values, ends, radius):
        linked, mine = label[near], label[i]
        if (other := linked[linked != mine]).size:
            merged = np.unique(np.append(other, mine))
            label[np.isin(label, merged)] = merged[0]
    return [(int(nodes[i]), int(nodes[label[i]])) for i in np.flatnonzero(label != np.arange(len(values))) if nodes[i] != nodes[label[i]]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams rows sorted by group; holds whole groups, which are bounded, until enough are together."""
        rest: list[np.ndarray] = []

        def work(rows: np.ndarray) -> pa.RecordBatch:
            group = rows[:, :3]
            change = np.flatnonzero(np.any(group[1:] != group[:-1], axis=1)) + 1
            bounds = np.append(change, len(rows))
            ends = np.repeat(bounds, np.diff(np.concatenate(([0], bounds))))
            edges = forest(np.ascontiguousarray(rows[:, 3]).view(np.uint64), rows[:, 4], ends, radius)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64, copy=False)
            rows = np.concatenate([*rest, rows])
            last = len(rows) - 1
            same = np.all(rows[:, :3] == rows[last, :3], axis=1)
            cut = int(np.argmax(same))
            rest = [rows[cut:]]
            if cut:
                yield work(rows[:cut])
        if rest:
            yield work(rest[0])

    return run


def block_keys(fp: str = "fp", radius: int = RADIUS, blocks: int | None = None) -> list[F.Column]:
    """A long for each combination of ``blocks - radius`` bit blocks; equal longs mean that those blocks agree."""
    blocks = radius + 2 if blocks is None else blocks
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    starts = [sum(widths[:k]) for k in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for k in chosen:
            key = F.shiftleft(key, widths[k]).bitwiseOR(F.shiftrightunsigned(F.col(fp), starts[k]).bitwiseAND(F.lit((1 << widths[k]) - 1).cast("long")))
        keys.append(key)
    return keys


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Fewest blocks whose keys are so long that ``n`` fingerprints share one with about four others by chance."""
    blocks = radius + 2
    while blocks < 4 * radius and 64 * (blocks - radius) // blocks < math.log2(max(n, 4)) - 2:
        blocks += 1
    return blocks


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between rows ``(fp, node)`` with distinct fingerprints: a spanning forest of every compared
    group, so components are those of all pairs within the radius."""
    blocks = blocks_for(nodes.count(), radius) if blocks is None else blocks
    return compared(nodes.select("fp", "node", F.explode(F.array(*block_keys("fp", radius, blocks))).alias("key")), radius, chunk)


def compared(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Spanning forests ``(a, b)`` of the links among rows ``(fp, node, key)`` of equal keys.

    Keys of many rows are dealt over pairs of chunks, so no task gets more than two chunks of a key.
    """
    spark = keyed.sparkSession
    ship(spark)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = keyed.join(counts, "key").withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    dealt = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "node"
    )
    dealt = dealt.repartition(shuffle_partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits, the document
    itself included. Null and wordless texts have fingerprint 0 and link like any other; repeated rows stay repeated;
    a null doc_id keeps its fingerprint and gets the component of its fingerprint's class if that has an id. Other
    columns are ignored, an empty table gives an empty one, and of very long texts all shingles count.
    """
    fps = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    component = connected_components(links(nodes.filter("node is not null"), radius))
    classes = nodes.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``: the one whose doc_id is the class's.

    Of rows that repeat that doc_id the one whose text is first in order stays. Of rows without an id, one of each
    fingerprint stays if no row with an id has that fingerprint. Texts are shuffled once, by doc_id.
    """
    found = materialise(near_duplicates(docs, shingle, seed, radius), "classes")
    heads = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("copies"))
    heads = materialise(heads, "heads")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body"))
    at = F.col("id") == F.col("kept_id")
    # the list of heads has no bound, so it is never sent along: both sides are dealt by id, and texts are not sorted
    rows = own.join(heads.filter("copies = 1").hint("shuffle_hash"), at, "left_semi").select("row.*")
    again = heads.filter("copies > 1")
    if again.head(1):
        first = Window.partitionBy("id").orderBy(F.col("body").asc_nulls_last())
        rows = rows.unionByName(own.join(again, at, "left_semi").withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*"))
    nameless = found.filter("doc_id is null and component_id is null").select("fingerprint").distinct()
    if nameless.head(1):
        rows = rows.unionByName(_with_fingerprint(docs.filter(F.col("doc_id").isNull()), nameless, shingle, seed))
    return rows


def _with_fingerprint(docs: DataFrame, wanted: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Rows of ``docs`` (without ids) whose fingerprint is in ``wanted``, one for each fingerprint."""
    body = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("binary").alias("body"))
    schema = body.select("row").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprints_of(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["row", "fp"])

    rows = body.mapInArrow(run, schema).withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    return rows.join(wanted, "fingerprint", "left_semi").dropDuplicates(["fingerprint"]).select("row.*")
