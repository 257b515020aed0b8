"""Target-distribution importance resampling over hashed n-grams, with an integer word dictionary.

Texts are cut into blocks of about ``BLOCK_WORDS`` words. A block codes its words by a dictionary of its own and
lists its distinct n-grams as tuples of these codes, with counts; documents keep indexes into that list. The words of
all blocks make the dictionary of the corpus, which gives each distinct word one integer id, and the blocks' tuples
become tuples of these ids. Counts are summed by tuple over all blocks, the bytes of each distinct tuple are put
together from the dictionary and hashed once, and its bucket is joined back to the blocks by tuple. So words are
shuffled once per block that has them, never once per occurrence; what is sent along is a row per bucket at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.session import materialise, numbered, ship

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Words of a block; a longer text is cut into pieces that count together.
BLOCK_WORDS = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A place in a block's list of n-grams has so many bits; what stands above them is the block's number.
_PLACE_BITS = 23
_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("features", pa.binary()),
        ("words", pa.list_(pa.binary())),
        ("tuples", pa.list_(pa.list_(pa.int32()))),
        ("counts", pa.list_(pa.int32())),
    ]
)
_BLOCK_DDL = (
    "block long, keys array<long>, doc_ids array<long>, n_words array<long>, sizes array<long>, features binary, "
    "words array<binary>, tuples array<array<int>>, counts array<int>"
)


class Block:
    """Pieces of texts as word codes, with the dictionary of their words."""

    def __init__(self, least: int, most: int) -> None:
        self.least, self.most = least, most
        self.codes: dict[bytes, int] = {}
        self.pieces: list[tuple[int, int | None, int, np.ndarray]] = []
        self.n = 0

    def add(self, key: int, doc_id: int | None, words: list[bytes], own: int) -> None:
        """A piece: of its words the first ``own`` begin n-grams here, the others are looked at from before only."""
        codes = self.codes
        self.pieces.append((key, doc_id, own, np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int32, len(words))))
        self.n += len(words)

    def record(self, number: int) -> pa.RecordBatch:
        found: list[np.ndarray] = [np.zeros((0, k), np.int32) for k in range(self.least, self.most + 1)]
        places: list[list[np.ndarray]] = []
        for at, k in enumerate(range(self.least, self.most + 1)):
            runs = [np.lib.stride_tricks.sliding_window_view(c, k)[:own] if len(c) >= k else np.zeros((0, k), np.int32) for _, _, own, c in self.pieces]
            flat = np.concatenate(runs) if runs else found[at]
            if k == 1:  # all codes occur, and a code is its own place
                found[at], index = np.arange(len(self.codes), dtype=np.int32)[:, None], flat[:, 0]
            else:
                found[at], index = np.unique(flat, axis=0, return_inverse=True)
            before = sum(len(x) for x in found[:at])
            places.append(np.split(index.reshape(-1).astype(np.int32) + np.int32(before), np.cumsum([len(r) for r in runs])[:-1]))
        parts = [np.concatenate(x) for x in zip(*places)]
        features = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        n = sum(map(len, found))
        if n >> _PLACE_BITS:
            raise ValueError("a block has too many n-grams: block_words must be smaller")
        tuples = [] if self.most == 1 else [t for x in found for t in x.tolist()]
        values = [
            number,
            [p[0] for p in self.pieces],
            [p[1] for p in self.pieces],
            [p[2] for p in self.pieces],
            [len(x) for x in parts],
            zlib.compress(features.astype("<i4").tobytes(), 1),
            list(self.codes),
            tuples,
            np.bincount(features, minlength=n).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)


def blocks(rows: DataFrame, key: str, least: int = 1, most: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of the texts of ``rows`` in the column ``text``, each with the ids of the column ``key``.

    A block's number is unique, and so is the key of a row; the table must be written before it is used twice. Of single
    words no tuples are listed: each is its own place in the block's dictionary.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 16
        row = number << 24
        block = Block(least, most)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                words = _WORD.findall(raw.lower()) if raw else []
                row += 1
                for at in range(0, max(1, len(words)), block_words):
                    own = min(block_words, len(words) - at)
                    if block.pieces and block.n + own > block_words:
                        yield block.record(number)
                        number, block = number + 1, Block(least, most)
                    block.add(row, doc_id, words[at : at + own + most - 1], own)
        if block.pieces:
            yield block.record(number)

    return rows.select(F.col(key).cast("long"), F.col("text").cast("binary")).mapInArrow(run, _BLOCK_DDL)


def _gain(s: Column, t: Column, in_documents: int, in_target: int, buckets: int) -> Column:
    """The logarithm of the ratio of smoothed shares, in thousandths, rounded down."""
    own, target = s.cast("double") + 1, t.cast("double") + 1
    return F.floor(F.log(target * (in_documents + buckets) / (own * (in_target + buckets))) * 1000).cast("long")


def _listed(both: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """``(side, ref, t0, t1, ..., n)``: each block's distinct n-grams as ids of the dictionary's words; ref is block and place."""
    words = both.select("side", "block", F.posexplode("words").alias("code", "word"))
    ref = (F.shiftleft("block", _PLACE_BITS) + F.col("place")).alias("ref")
    if most == 1:
        own = both.select("side", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("side", ref, F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
        return own.join(dictionary, "word").select("side", "ref", F.col("word_id").alias("t0"), "n")
    ids = words.join(dictionary, "word").groupBy("side", "block").agg(F.array_sort(F.collect_list(F.struct("code", "word_id")))["word_id"].alias("ids"))
    named = both.select("side", "block", "tuples", "counts").join(ids, ["side", "block"])
    named = named.select("side", "block", F.transform("tuples", lambda t: F.transform(t, lambda c: F.get("ids", c))).alias("tuples"), "counts")
    rows = named.select("side", "block", F.posexplode(F.arrays_zip("tuples", "counts")).alias("place", "x"))
    return rows.select("side", ref, *(F.get("x.tuples", F.lit(k)).alias(f"t{k}") for k in range(most)), F.col("x.counts").alias("n"))


def weights(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(key, doc_id, n_words, n_features, weight)`` of every row of ``docs``; key tells rows apart.

    ``target`` is any table with a column text whose distribution is the aim; features are the runs of ``least`` to
    ``most`` words.
    """
    own = materialise(blocks(docs, "doc_id", least, most, block_words), "blocks")
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    aim = materialise(blocks(aim, "doc_id", least, most, block_words), "target")
    both = own.select(F.lit(0).alias("side"), "block", "words", "tuples", "counts").unionByName(aim.select(F.lit(1).alias("side"), "block", "words", "tuples", "counts"))
    words = both.select(F.explode("words").alias("word")).distinct()
    dictionary = materialise(words.withColumn("word_id", F.monotonically_increasing_id()), "dictionary")
    ids = [f"t{k}" for k in range(most)]
    # rows of a tuple of one word still lie together where they are written, so that tasks count most of them alone
    listed = materialise(_listed(both, dictionary, most), "tuples")
    counts = listed.groupBy(*ids).agg(*(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate("st")))
    for k in range(most):
        named = dictionary.select(F.col("word_id").alias(f"t{k}"), F.col("word").cast("string").alias(f"w{k}"))
        counts = counts.join(named, f"t{k}", "left")
    text = F.concat_ws(" ", *(f"w{k}" for k in range(most)))
    hashed = materialise(counts.select(*ids, (F.crc32(text) % buckets).cast("int").alias("bucket"), "s", "t"), "hashed")

    sums = materialise(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    gains = sums.select("bucket", _gain(F.col("s"), F.col("t"), total["s"], total["t"], buckets).cast("int").alias("gain"))
    priced = hashed.select(*ids, "bucket").join(F.broadcast(gains), "bucket").select(*ids, "gain")
    same = reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ids))
    back = listed.filter("side = 0").alias("l").join(priced.alias("p"), same).select(F.shiftright("l.ref", _PLACE_BITS).alias("block"), F.col("l.ref").bitwiseAND((1 << _PLACE_BITS) - 1).cast("int").alias("place"), "p.gain")

    pieces = own.select("block", "keys", "doc_ids", "n_words", "sizes", "features")
    weighed = pieces.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_weigh, "key long, doc_id long, n_words long, n_features long, weight long")
    return weighed.groupBy("key", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))


def _weigh(pieces: pa.Table, gains: pa.Table) -> pa.Table:
    """Sums of gains of a block's pieces."""
    if not pieces.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("key", "doc_id", "n_words", "n_features", "weight")})
    keys, doc_ids, n_words, sizes = (pieces.column(c).combine_chunks().values for c in ("keys", "doc_ids", "n_words", "sizes"))
    features = np.frombuffer(zlib.decompress(pieces.column("features")[0].as_py()), "<i4")
    by_place = np.zeros(gains.num_rows, np.int64)
    by_place[gains.column("place").to_numpy()] = gains.column("gain").to_numpy()
    own = np.zeros(len(features) + 1, np.int64)
    np.cumsum(by_place[features], out=own[1:])
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    weight = own[ends] - own[ends - sizes.to_numpy(zero_copy_only=False)]
    return pa.table({"key": keys, "doc_id": doc_ids, "n_words": n_words, "n_features": sizes, "weight": pa.array(weight)})


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A standard Gumbel value in thousandths, rounded down, from the digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)) * -1000.0).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score and rank (null: not drawn).

    A score is the weight plus Gumbel noise, so the highest scores are a sample without replacement in proportion to the
    likelihood ratios; of the rows of ``least_words`` words or more the ``percent`` highest are drawn, ties to smaller
    ids. Null and empty texts have no features and weight 0; very long texts are counted whole, in pieces; repeated rows
    are rows of their own, and where even their ids are equal their order is by place; a null doc_id is drawn for as an
    empty string, and stands before others in ties. An empty ``target`` leaves gains of its smoothed, even shares; empty
    ``docs`` give an empty table. Other columns are ignored.
    """
    rows = weights(docs, target, least, most, buckets, block_words)
    scored = rows.withColumns({"score": F.col("weight") + draw(F.col("doc_id"), seed), "may": F.col("n_words") >= least_words})
    scored = materialise(scored.withColumns({"_last": (~F.col("may")).cast("int"), "_down": -F.col("score")}), "scored")
    drawn = scored.filter("may").count() * percent // 100
    ranked = numbered(scored, ["_last", "_down", "doc_id", "key"], "rank")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TABLE = "list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
_CRC = "xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
c AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (
  SELECT unnest(w) AS word, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY word),
tab AS (SELECT list({_TABLE} ORDER BY n) AS tab FROM (SELECT unnest(range(256)) AS n)),
bytes AS (SELECT word, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i : i + 1] AS BIGINT)) AS b FROM (SELECT word, hex(encode(word)) AS h FROM c)),
crc AS (SELECT word, {_CRC} % {BUCKETS} AS bucket FROM bytes, tab),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(sum(t) + 1 AS DOUBLE) * (any_value(ss) + {BUCKETS}) / (CAST(sum(s) + 1 AS DOUBLE) * (any_value(tt) + {BUCKETS})))) AS BIGINT) AS gain
  FROM c JOIN crc USING (word), (SELECT sum(s) AS ss, sum(t) AS tt FROM c) GROUP BY bucket),
f AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN crc USING (word) JOIN g USING (bucket) GROUP BY doc_id),
s AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
