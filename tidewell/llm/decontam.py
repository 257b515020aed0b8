"""Benchmark passages in documents by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (all of a shorter one). Each window's words are ordered by how
rare they are in the corpus; as a window must occur whole, its rarest word is the prefix that any containing document
must share. Windows, words and prefixes are tables. What is sent along is a filter of fixed size (``filters``) with the
prefixes, their places in windows and the windows themselves: a document offers a run of words to the join where a word
of it is a prefix, the run that follows from its place lies within the document and the filter knows it. Runs are joined on
their words, so what the filter lets through by chance is dropped there; what it lacks occurs in no item.

Two passes read the documents, whatever the size of the benchmark: one counts the benchmark's words, one offers runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewell.llm import filters
from tidewell.session import materialise, released, ship

WINDOW = 10

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HITS_DDL = "array<struct<start: int, end: int>>"
#: Documents and bytes of text that are looked at together, and words that a worker remembers at most, about.
_ROWS, _BYTES, _REMEMBERED = 256, 1 << 21, 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8."""
    return _WORD.findall(text.lower()) if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))]


def merge(ranges: set[tuple[int, int]] | list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap as one."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(window, n, item_id)`` of all windows of all items; an item is passed on window by window, a few thousand at a time."""
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py())
                n, last = min(window, len(words)), max(1, len(words) - window + 1) if words else 0
                for at in range(0, last, 4096):
                    own = [b" ".join(words[k : k + n]) for k in range(at, min(last, at + 4096))]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(np.full(len(own), n, np.int32)), pa.array([item.as_py()] * len(own), pa.string())], ["window", "n", "item_id"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(released(run), "window binary, n int, item_id string").distinct()


def word_counts(docs: DataFrame, known: filters.Filter) -> DataFrame:
    """``(word, count)`` over all of ``docs`` of the words that ``known`` lets through; summed within tasks before the shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shared.value, {}
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                own: Counter[bytes] = Counter()
                for text in batch.column(0).slice(at, _ROWS):
                    own.update(words_of(text.as_py()))
                new = [w for w in own if w not in seen]
                seen.update(zip(new, known.has(new)))
                counts.update({w: n for w, n in own.items() if seen[w]})
                if len(seen) > _REMEMBERED:
                    seen.clear()
                if len(counts) > _REMEMBERED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return docs.select(F.col("text").cast("binary")).mapInArrow(released(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("count"))


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def prefixes(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """``(window, word, place, n)``: of each window the word that is rarest by ``counts``, ties to the smaller word and place."""
    words = distinct.select("window", "n", F.posexplode(F.split(F.decode("window", "ISO-8859-1"), " ")).alias("place", "word"))
    words = words.withColumn("word", F.encode("word", "ISO-8859-1")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "place")).alias("least")
    return words.groupBy("window", "n").agg(rarest).select("window", "least.word", "least.place", "n")


def _place_key(word: bytes, place: int, n: int) -> bytes:
    """How the filter holds that ``word`` is the prefix of windows of ``n`` words at ``place``; no window has these bytes."""
    return b"%s %d/%d" % (word, place, n)


class _Places:
    """The ``(place, n)`` pairs of words that the filter may hold; other words that were seen are only remembered."""

    def __init__(self, known: filters.Filter, sizes: list[int]) -> None:
        self.known, self.pairs = known, [(place, n) for n in sizes for place in range(n)]
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        self.seen: set[bytes] = set()

    def learn(self, texts: list[list[bytes]]) -> None:
        """Look up the words of ``texts`` that are new, all together."""
        words = set().union(*texts)
        if len(self.seen) > _REMEMBERED:
            self.seen, self.prefixes = set(), {}
        new = list(words - self.seen)
        self.seen |= words
        prefix = [w for w, ok in zip(new, self.known.has([w + b" /" for w in new]).tolist()) if ok]
        if prefix:
            found = self.known.has([_place_key(w, *p) for w in prefix for p in self.pairs]).reshape(len(prefix), -1)
            for w, own in zip(prefix, found.tolist()):
                if any(own):
                    self.prefixes[w] = [p for p, ok in zip(self.pairs, own) if ok]

    def runs(self, words: list[bytes]) -> list[tuple[int, int]]:
        """``(start, n)`` of the runs of ``words`` that some prefix calls for, within bounds."""
        prefixes, last = self.prefixes, len(words)
        at = [k for k, w in enumerate(words) if w in prefixes]
        return sorted({(k - place, n) for k in at for place, n in prefixes[words[k]] if 0 <= k - place <= last - n})


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``_ROWS`` rows and about ``_BYTES`` of a column."""
    at, held = 0, 0
    for k, value in enumerate(batch.column(column)):
        size = value.as_buffer().size if value.is_valid else 0
        if k > at and (held + size > _BYTES or k - at == _ROWS):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if batch.num_rows:
        yield batch.slice(at)


def _offers(docs: DataFrame, known: filters.Filter, sizes: list[int]) -> DataFrame:
    """The rows of ``docs`` (own columns, body) with key, n_words and the runs that they offer, body aside."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    kept = docs.drop("body")
    schema = T.StructType([*kept.schema.fields, T.StructField("key", T.LongType()), T.StructField("n_words", T.LongType())])
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("window", pa.binary())]))
    body = docs.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, places, key = shared.value, _Places(shared.value, sizes), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _parts(batch, body):
                texts = [words_of(text.as_py()) for text in part.column(body)]
                places.learn(texts)
                runs = [places.runs(words) for words in texts]
                found = [b" ".join(words[start : start + n]) for words, own in zip(texts, runs) for start, n in own]
                held = iter(zip(found, known.has(found).tolist()))
                offers = [[{"start": start, "n": n, "window": w} for (start, n), (w, ok) in zip(own, held) if ok] for own in runs]
                n_words = list(map(len, texts))
                keys = np.arange(key, key + part.num_rows)
                key += part.num_rows
                columns = [c for k, c in enumerate(part.columns) if k != body]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys), pa.array(n_words, pa.int64()), pa.array(offers, run_type)], [*schema.names, "offers"])

    return docs.mapInArrow(released(run), T.StructType([*schema.fields, *T.StructType.fromDDL("offers array<struct<start: int, n: int, window: binary>>").fields]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [[{"start": a, "end": b} for a, b in merge([(h["start"], h["end"]) for h in own])] for own in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["key", "hits"])


def contamination(docs: DataFrame, benchmark: DataFrame, carry: bool = False, window: int = WINDOW, most_bits: int = filters.MOST_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, hits (ranges of word positions) and items (sorted ids found).

    With ``carry`` the row's own columns come as the struct ``row`` instead of doc_id. Null texts have no words, an
    item without words has no window, repeated items count once by id, a null item_id shows as the empty string. Very long
    texts are matched whole, repeated rows are rows of their own. An empty benchmark leaves every document clean; empty
    documents give an empty table. ``most_bits`` bounds the filter that is sent along; a filter too small for its windows
    lets more runs through to the join, which changes nothing else.
    """
    ship(docs.sparkSession)
    listed = materialise(windows(benchmark, window), "windows")
    distinct = listed.select("window", "n").distinct()
    sizes = sorted(r["n"] for r in listed.select("n").distinct().collect())  # ``window`` of them at most
    vocabulary = distinct.select(F.explode(F.split(F.decode("window", "ISO-8859-1"), " ")).alias("w")).distinct().select(F.encode("w", "ISO-8859-1").alias("key"))
    counts = materialise(word_counts(docs, filters.build(vocabulary, most_bits)), "counts")
    first = materialise(prefixes(distinct, counts), "prefixes")
    mark = F.concat(F.lit(b" "), F.concat_ws("/", "place", "n").cast("binary"))
    entries = first.select(F.explode(F.array("window", F.concat("word", F.lit(b" /")), F.concat("word", mark))).alias("key"))
    known = filters.build(entries, most_bits)

    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if carry else F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("body"),
    )
    offered = materialise(_offers(own, known, sizes), "offered")
    runs = offered.filter(F.size("offers") > 0).select("key", F.explode("offers").alias("o")).select("key", "o.start", "o.n", "o.window")
    met = materialise(runs.join(distinct.select("window"), "window"), "met")
    hits = met.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("hits")).mapInArrow(_merged, f"key long, hits {_HITS_DDL}")
    items = met.select("key", "window").distinct().join(listed.select("window", "item_id"), "window").select("key", "item_id").distinct()
    items = items.groupBy("key").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = hits.join(items, "key")
    name = offered.columns[0]
    empty = lambda c, ddl: F.coalesce(c, F.array().cast(ddl)).alias(c)
    clean = offered.filter(F.size("offers") == 0).select(name, "n_words", F.array().cast(_HITS_DDL).alias("hits"), F.array().cast("array<string>").alias("items"))
    rest = offered.filter(F.size("offers") > 0).select(name, "key", "n_words").join(found, "key", "left")
    return clean.unionByName(rest.select(name, "n_words", empty("hits", _HITS_DDL), empty("items", "array<string>")))


def digest(found: DataFrame) -> DataFrame:
    """The counts and the item digest of what ``contamination`` found."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of any item.

    Rows with a null text stay, as they have no words; long and repeated rows are judged as in ``contamination``.
    """
    return contamination(docs, benchmark, carry=True).filter(F.size("hits") == 0).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win), g AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), m AS (SELECT g.doc_id, g.k, g.n, win.item_id FROM g JOIN win ON g.s = win.s AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
