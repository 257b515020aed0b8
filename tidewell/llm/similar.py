"""Near-duplicate documents by shared word shingles: SimHash comparison finds candidates, their shingles decide.

Two documents are linked if their sets of ``SHINGLE``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more. At that
similarity fingerprints differ in about ten of 64 bits, too many for keys of agreeing bit blocks, so fingerprints meet on bands of
minimum hashes (``BINS`` bins of one permutation, ``BIN_ROWS`` a band; a pair of similarity 0.8 misses all bands once in five
thousand) and are compared bit-sliced within ``RADIUS`` bits (missed about once in a thousand). Spanning forests of these
comparisons give candidate groups. Within them shingle sets are compared: each bounded part of a group together with the
group's first text, and then what did not join that text against all parts, so a large group of copies costs little more than its
rows and no pair that was a candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.components import connected_components
from tidewell.llm.simhash import CHUNK, SEED, compared, hits_by_tile, majority, shingle_digests
from tidewell.session import materialise, released, ship, shuffle_partitions

SHINGLE, SIMILARITY = 5, 0.8
BINS, BIN_ROWS = 64, 4
RADIUS = 18
#: Bits of the filter of candidate texts at most, and bits a text up to there.
FILTER_BITS, BITS_A_TEXT = 1 << 26, 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = " \t\n\x0b\x0c\r"


def shingle_set(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, shingle, seed)), ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minimum hashes of a set; an empty bin takes the next one's minimum, marked by its distance."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    at = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << shift)
    owner = (hashes >> shift).astype(np.int64)
    place = np.where(at < len(hashes), at, 0)
    distance = (owner[place] - np.arange(BINS)) % BINS
    rows = ((hashes[place] + distance.astype(np.uint64) * _MIX) * _MIX).reshape(-1, BIN_ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(BIN_ROWS):
        key = (key ^ rows[:, k]) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _with_node(docs: DataFrame) -> DataFrame:
    """``docs`` as the struct row with doc_id, body, digest (of the text; one for all wordless ones) and its head as the long node."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.when(F.btrim(text, F.lit(_BLANKS)) == "", F.repeat(F.lit("0"), F.lit(32))).otherwise(F.md5(text.cast("binary")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("body"), digest.alias("digest"))
    return rows.withColumn("node", F.conv(F.substring("digest", 1, 16), 16, -10).cast("long"))


def sketches(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(doc_id, digest, node, fp, keys)`` of rows (doc_id, digest, node, body): fingerprint and band keys of the shingle set."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle, seed) for t in part.column(3).to_pylist()]
                fps = majority(np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets)))
                keys = [bands(s).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "node", "fp", "keys"])

    return rows.select("doc_id", "digest", "node", "body").mapInArrow(released(run), "doc_id long, digest string, node long, fp long, keys array<long>")


def _filter(nodes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit set of bounded size that holds the nodes: a word for each 64 places, summed up by executors."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (BITS_A_TEXT * n - 1).bit_length()))
    place = F.col("node").bitwiseAND(F.lit(bits - 1))
    words = nodes.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((node & {bits - 1}) & 63 as int))")).alias("b")).collect()
    out = np.zeros(bits // 64, np.int64)
    out[[r["w"] for r in words]] = [r["b"] for r in words]
    return out.view(np.uint64), bits


def sets_of(rows: DataFrame, nodes: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``(node, fp, set)`` of the texts whose node is in ``nodes`` (distinct), and of a few others that pass the filter.

    Where nodes are too many for a filter of its largest size, texts are joined to them first, so that no set of a text
    that is no candidate is ever sent.
    """
    spark, n = rows.sparkSession, nodes.count()
    if n * BITS_A_TEXT > 4 * FILTER_BITS:
        rows = rows.select("node", "body").join(nodes.select("node"), "node", "left_semi")
    words, bits = _filter(nodes, n)
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = shared.value, set()
        for batch in batches:
            place = batch.column(0).to_numpy().astype(np.int64) & (bits - 1)
            held = (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            part = batch.filter(pa.array(held))
            for at in range(0, part.num_rows, 256):
                own = {n: t for n, t in zip(part.column(0).slice(at, 256).to_pylist(), part.column(1).slice(at, 256).to_pylist()) if n not in seen}
                if len(seen) < 100_000:  # copies in a task are passed over; others meet below
                    seen |= own.keys()
                sets = [shingle_set(t, shingle, seed) for t in own.values()]
                fps = majority(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.fromiter(map(len, sets), np.int64, len(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(fps.view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "fp", "set"])

    found = rows.select("node", "body").mapInArrow(released(run), "node long, fp long, set array<long>")
    return found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("set").alias("set"))


def linked(fps: np.ndarray, sets: list[np.ndarray], similarity: float, apart: np.ndarray | None = None) -> np.ndarray:
    """Labels of the rows' groups by links of ``similarity`` among rows within the radius; each the smallest row of its group.

    Pairs already in one group are not compared; with ``apart`` only pairs of which one row is marked so.
    """
    label = np.arange(len(fps))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    for i, near in hits_by_tile(fps, np.full(len(fps), len(fps)), RADIUS):
        if apart is not None and not apart[i]:
            near = near[apart[near]]
        low, high = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[low >= similarity * high]
        while len(near := near[label[near] != label[i]]):
            j = int(near[0])
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= similarity * (sizes[i] + sizes[j] - both):
                merged = sorted((label[i], label[j]))
                label[label == merged[1]] = merged[0]
            near = near[1:]
    return label


def _verify(similarity: float, some: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (x, y, component, node, fp, apart, set) sorted by the first three; whole groups, which are bounded, at a time."""
        held: list[pa.RecordBatch] = []

        def work() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            order = np.argsort(rows.column(3).to_numpy(), kind="stable")  # the component's first text is its smallest node
            nodes, fps = rows.column(3).to_numpy()[order], rows.column(4).to_numpy()[order].view(np.uint64)
            flat, offsets = rows.column(6).values.to_numpy().view(np.uint64), rows.column(6).offsets.to_numpy()
            sets = [flat[offsets[k] : offsets[k + 1]] for k in order]
            apart = rows.column(5).to_numpy(zero_copy_only=False)[order] if some else None
            label = linked(fps, sets, similarity, apart)
            moved = np.flatnonzero(label != np.arange(len(label)))
            moved = moved[nodes[moved] != nodes[label[moved]]]
            return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["a", "b"])

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and [c[0].as_py() for c in held[0].columns[:3]] != keys[a].tolist():
                        yield work()
                        held.clear()
                    held.append(batch.slice(a, b - a))
        if held:
            yield work()
            held.clear()

    return run


def sized(candidates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(node, component, parts, x)``: how many parts a component has, and which a node is in."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int")
    rows = candidates.join(candidates.groupBy("component").agg(F.count("*").alias("n")), "component")
    return rows.select("node", "component", parts.alias("parts")).withColumn("x", F.pmod(F.xxhash64("node"), "parts").cast("int"))


def verified(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` by shingle sets among written rows (component, node, fp, set, parts, x) of equal component, whose
    smallest node it is."""
    spark = dealt.sparkSession

    def compare(rows: DataFrame, some: bool) -> DataFrame:
        rows = rows.select("x", "y", "component", "node", "fp", "apart", "set").repartition(shuffle_partitions(spark), "x", "y", "component").sortWithinPartitions("x", "y", "component")
        return rows.mapInArrow(released(_verify(similarity, some)), "a long, b long")

    mark = lambda rows, apart: rows.withColumn("apart", F.lit(apart))
    first = mark(dealt.filter("node = component").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), True)
    rest = mark(dealt.filter("node <> component"), True)
    links = materialise(compare(first.unionByName(rest).withColumn("y", F.lit(0)), False), "verified")
    if not dealt.filter("parts > 1").head(1):
        return links
    joined = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    far = dealt.filter("parts > 1 and node <> component").join(joined, "node", "left").filter("root is null or root <> component").drop("root")
    far = materialise(far.dropDuplicates(["component", "node"]), "apart")
    if not far.head(1):
        return links
    left = mark(far.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), True)
    used = far.select("component", "x").distinct()
    right = dealt.filter("parts > 1").withColumn("y", F.col("x")).drop("x").join(used, "component")
    right = mark(right, False).join(far.select("component", "node", F.lit(True).alias("_far")), ["component", "node"], "left")
    right = right.filter((F.col("x") != F.col("y")) | F.col("_far").isNull()).drop("_far")
    return links.unionByName(compare(left.select(*dealt.columns, "y", "apart").unionByName(right.select(*dealt.columns, "y", "apart")), True))


def classes(rows: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """``(doc_id, digest, node, class)`` of every row of ``_with_node``: class is the same for linked documents."""
    found = materialise(sketches(rows, shingle, seed), "sketches")
    texts = materialise(found.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    candidates = connected_components(compared(texts.select("fp", "node", F.explode("keys").alias("key")), RADIUS))
    candidates = materialise(sized(candidates), "candidates")
    # sets are dealt by node already; a candidate's component comes to them at every size
    members = sets_of(rows, candidates.select("node"), shingle, seed).join(candidates.hint("merge"), "node")
    groups = connected_components(verified(materialise(members, "members"), similarity))
    return found.select("doc_id", "digest", "node").join(groups, "node", "left").select("doc_id", "digest", "node", F.coalesce(F.col("component").cast("string"), F.col("digest")).alias("class"))


def drop_similar(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED) -> DataFrame:
    """``docs`` with one row of each class of linked documents: the one with the smallest doc_id.

    Null and wordless texts are one class, texts of fewer words than a shingle are one shingle. Rows without an id stay only
    where no row of their class has one; of rows of equal id and text one stays, of rows of equal id the one whose text's
    digest is first. Very long texts are compared whole, columns stay whatever their names, and an empty table gives an
    empty one.
    """
    rows = _with_node(docs)
    found = materialise(classes(rows, shingle, similarity, seed), "classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "digest")).alias("k"))
    keep = materialise(best.select(F.col("k.doc_id").alias("kept_id"), F.col("k.digest").alias("kept_digest")), "kept")
    # the list has no bound, so it is never sent along: both sides are dealt by digest and id
    at = (F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    out = rows.select("row", "doc_id", "digest").join(keep.hint("shuffle_hash"), at, "left_semi")
    again = found.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").join(keep, at, "left_semi")
    if again.head(1):
        out = out.dropDuplicates(["doc_id", "digest"])
    return out.select("row.*")
