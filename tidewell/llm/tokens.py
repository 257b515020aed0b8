"""Token-id shards: exact tokenization with a cache of white-space chunks, Re-Pair compressed binary files.

A shard is one frame of a file (see ``binfiles``), little-endian throughout::

    magic "TWR1" | u32 docs | u64 ids | u32 base | u32 rules | u32 symbols | u8 symbol width | u32 samples
    i64 doc_id[docs] | u8 null[docs] | u32 n_tokens[docs] | u32 rule[rules][2] | u32 expansion[rules]
    u64 sample[samples] (ids before every SAMPLE-th symbol) | symbol[symbols] | u32 crc32 of all before
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewell.llm import binfiles, repair
from tidewell.llm.repair import ragged
from tidewell.session import give_back, materialise, released, scratch, ship, shuffle_partitions

#: Ids of a shard, but for a document that goes beyond them.
SHARD_IDS = 1 << 20
#: Bytes of text that a file of shards is made of, about.
FILE_BYTES = 16 << 20
#: Distinct pieces of words that a worker remembers at most.
CACHE = 600_000
END_ID = 1
#: Texts that are encoded together, and chunks whose ids are gathered at once.
BATCH, _GATHER = 1024, 1 << 16

_HEAD = struct.Struct("<4sIQIIIBI")
_MAGIC = b"TWR1"
#: Vocabularies whose white space only parts words are recognised by these parts of their files: fixed values.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of one code point that NFC leaves and lower case maps to one such letter.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-į"
#: A chunk of such letters, with or without ASCII marks before it (no apostrophe, which may begin a suffix) and after it.
_PLAIN = rf"^(?P<lead>[!-&(-/:-@\[-`{{-~]*)(?P<word>[{_LETTERS}]+)(?P<tail>[!-/:-@\[-`{{-~]*)$"


def parts_words(config: dict) -> bool:
    """Whether a tokenizer's parts are those that ``Encoder`` may take apart at white space: lower-cased words and runs of
    marks that each end in a token with the model's end-of-word suffix."""
    try:
        normalizer, split, model = config["normalizer"], config["pre_tokenizer"]["pretokenizers"], config["model"]
        return (
            [x["type"] for x in normalizer["normalizers"]] == _NORMALIZERS
            and normalizer["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
            and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"]
            and model["type"] == "BPE"
            and bool(model["end_of_word_suffix"])
            and not model["dropout"]
            and not any(x["normalized"] for x in config["added_tokens"])
        )
    except (KeyError, TypeError, IndexError):
        return False


class Encoder:
    """Ids of whole texts as the tokenizer gives them, without special tokens.

    Where white space only parts words (see ``parts_words``), a space or line feed always ends a pre-token and no
    normalization reaches over it, so a text's ids are those of its chunks, and chunks repeat. Chunks of plain letters
    between ASCII marks are three pieces, each encoded once; any other chunk goes through the tokenizer as a whole. With
    every other vocabulary whole texts go through the tokenizer.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.cache = cache
        config = json.loads(self.tokenizer.to_str())
        self.by_piece = parts_words(config)
        if self.by_piece:
            suffix = config["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.size, bool)
            self.ends[[i for t, i in config["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words or runs of marks: together, parted where a token ends a word."""
        ids = np.array(self._plain([" ".join(words)])[0], np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words):
            return ids, np.diff(stops, prepend=0)
        return self._listed(self._plain(words))

    @staticmethod
    def _listed(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum())), lengths

    def _codes_of(self, pieces: pa.Array, whole: bool = False) -> np.ndarray:
        """The code of each of ``pieces``; new ones are encoded. ``whole`` marks chunks that are no plain pieces."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        keys = ["\n" + x for x in names] if whole else names
        found = np.fromiter(map(self.codes.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(found < 0)):
            fresh = [names[k] for k in new]
            if whole:
                ids, lengths = self._listed(self._plain(fresh))
            else:
                parts = [self._words(fresh[at : at + 256]) for at in range(0, len(fresh), 256)]
                ids, lengths = (np.concatenate(x) for x in zip(*parts))
            found[new] = known = len(self.codes) + np.arange(len(new))
            self.codes.update(zip((keys[k] for k in new), known.tolist()))
            self._keep(known, ids, lengths)
        return found[coded.indices.to_numpy()]

    def _keep(self, known: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.codes) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[known], self.length[known] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def _pieces(self, chunks: pa.Array) -> np.ndarray:
        """Codes ``[chunks, 3]`` of the pieces of distinct chunks."""
        # an added token may stand in a chunk that holds its opening mark
        plain = pc.extract_regex(pc.if_else(pc.match_substring(chunks, "<|"), pa.scalar(None, chunks.type), chunks), _PLAIN)
        fits = plain.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(chunks), 3), np.int64)
        if fits.any():
            plain = plain.drop_null()
            for k, part in enumerate(("lead", "word", "tail")):
                own = pc.struct_field(plain, part)
                out[fits, k] = self._codes_of(pc.utf8_lower(own) if part == "word" else own)
        if not fits.all():
            out[~fits, 1] = self._codes_of(chunks.filter(pa.array(~fits)), whole=True)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)``: the ids of all texts one after the other; null counts as empty."""
        if not self.by_piece:
            return self._listed(self._plain([t or "" for t in texts.to_pylist()]))
        if len(self.codes) > self.cache:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        pieces = self._pieces(coded.dictionary)
        sizes = self.length[pieces]
        flat = self.flat[ragged(self.start[pieces].ravel(), sizes.ravel())]
        own = sizes.sum(axis=1)
        first = np.cumsum(own) - own
        codes = coded.indices.to_numpy()
        lengths = own[codes]
        ids, at = np.empty(int(lengths.sum()), np.uint32), 0
        for k in range(0, len(codes), _GATHER):  # indices are eight bytes an id, so they are made piece by piece
            part = ragged(first[codes[k : k + _GATHER]], lengths[k : k + _GATHER])
            ids[at : at + len(part)] = flat[part]
            at += len(part)
        stops = np.cumsum(pc.list_value_length(parts).to_numpy())
        return ids, np.add.reduceat(lengths, np.concatenate(([0], stops[:-1]))) if len(texts) else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file; workers that Spark reuses keep it between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """One shard's bytes."""
    rules, seq = repair.compress(ids, base)
    sizes = repair.sizes_of(rules, base)
    each = np.ones(len(seq), np.int64)
    inner = seq >= base
    each[inner] = sizes[seq[inner].astype(np.int64) - base]
    samples = (np.cumsum(each) - each)[:: repair.SAMPLE]
    head = _HEAD.pack(_MAGIC, len(doc_ids), len(ids), base, len(rules), len(seq), seq.itemsize, len(samples))
    body = b"".join(
        (
            head,
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            lengths.astype("<u4").tobytes(),
            rules.astype("<u4").tobytes(),
            sizes.astype("<u4").tobytes(),
            samples.astype("<u8").tobytes(),
            seq.astype(f"<u{seq.itemsize}").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard's parts; ``end`` is the offset of the byte after it. Raises ValueError for damaged bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        _, docs, self.n_ids, self.base, rules, symbols, width, samples = _HEAD.unpack_from(data, at)
        self.end = at + frame_bytes(data, at)
        p = at + _HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal p
            out = np.frombuffer(data, dtype, n, p)
            p += out.nbytes
            return out

        self.doc_ids, self.null, self.lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.rules, self.sizes = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.samples, self.seq = take("<u8", samples), take(f"<u{width}", symbols)
        if struct.unpack_from("<I", data, p)[0] != zlib.crc32(memoryview(data)[at:p]):
            raise ValueError("token shard fails its checksum")

    def ids(self) -> np.ndarray:
        return repair.expand_all(self.seq, self.rules, self.sizes, self.base)

    def range(self, start: int, stop: int, touched: set[int] | None = None) -> np.ndarray:
        """Ids ``start .. stop``, from the last sampled symbol at or before ``start`` on, by the rules' stored lengths.

        Only rules that hold ids of the range are read; ``touched`` collects them.
        """
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.samples, start, "right")) - 1
        last = int(np.searchsorted(self.samples, stop, "left"))
        part = self.seq[first * repair.SAMPLE : last * repair.SAMPLE]
        return repair.expand(part, self.rules, self.sizes, self.base, start - int(self.samples[first]), stop - start, touched)

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document."""
        stop = int(self.lengths[: k + 1].sum(dtype=np.int64))
        return self.range(stop - int(self.lengths[k]), stop)


def frame_bytes(head: bytes, at: int = 0) -> int:
    """Bytes of the shard whose head stands at ``at``; ValueError if none does."""
    if len(head) < at + _HEAD.size or head[at : at + 4] != _MAGIC:
        raise ValueError("not a token shard")
    _, docs, _, _, rules, symbols, width, samples = _HEAD.unpack_from(head, at)
    return _HEAD.size + 13 * docs + 12 * rules + 8 * samples + width * symbols + 4


def heads(file: binfiles.RangeFile) -> Iterator[tuple[int, int, int]]:
    """``(offset, bytes, ids)`` of the shards of a file, which a line feed follows each; only heads are read."""
    at = 0
    while at < file.size:
        head = file.read(at, _HEAD.size)
        size = frame_bytes(head)
        yield at, size, _HEAD.unpack(head)[2]
        at += size + 1


def _files(rows: DataFrame, file_bytes: int) -> int:
    """How many files ``rows`` (text) are worth: by their bytes, whatever the session's partitions."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // file_bytes))


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text of ``docs`` (null: no ids) and write shards in ascending doc_id order, nulls first.

    Rows of equal doc_id are ordered by their text's hash, then text, so that an id of many rows can be several files.
    Each document ends with ``end_id``. One shuffle by ranges of id and hash into files of about ``file_bytes`` of
    text; a task holds one shard of ids and a batch of texts.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        names, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held
            frame = pack_shard([x for n in names for x in n.to_pylist()], np.concatenate(lengths), np.concatenate(parts), enc.size)
            names.clear(), lengths.clear(), parts.clear()
            held = 0
            give_back()
            return pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                ids, sizes = enc.encode(part.column(1))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ends, done, first = np.cumsum(sizes), 0, 0
                while first < len(sizes):  # up to the document that fills the shard
                    last = min(int(np.searchsorted(ends, done + shard_ids - held)) + 1, len(sizes))
                    names.append(part.column(0).slice(first, last - first)), lengths.append(sizes[first:last]), parts.append(ids[done : ends[last - 1]])
                    held += int(ends[last - 1]) - done
                    done, first = int(ends[last - 1]), last
                    if held >= shard_ids:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(_files(rows, file_bytes), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    binfiles.write_frames(ordered.select("doc_id", "text").mapInArrow(released(run), "frame binary"), path)


def shard_places(spark: SparkSession, path: str) -> DataFrame:
    """``(part, path, offset, bytes, before)`` of the shards below ``path``, from their heads; before counts the ids of all
    shards before it in file order."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with binfiles.RangeFile(uri) as file:
                    rows = list(heads(file))
                own = np.array([x[2] for x in rows], np.int64)
                kinds = [pa.array([part] * len(rows), pa.int32()), pa.array([uri] * len(rows), pa.string()), *(pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1, 2)), pa.array(np.cumsum(own) - own)]
                yield pa.RecordBatch.from_arrays(kinds, ["part", "path", "offset", "bytes", "ids", "own"])

    files = binfiles.files(spark, path).mapInArrow(run, "part int, path string, offset long, bytes long, ids long, own long")
    places = materialise(files, "places")
    # one row a file: its ids, and those of the files before it
    sizes = places.groupBy("part").agg(F.sum("ids").alias("all"))
    before = sizes.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("files_before"))
    return places.join(before, "part").select("part", "path", "offset", "bytes", (F.col("files_before") + F.col("own")).alias("before"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files below ``path``.

    start counts the ids of all documents before it in file order; ids_crc32 is over its decoded ids as
    little-endian unsigned 32-bit integers. Shards are read as byte ranges, one at a time, so files may be of any size.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with binfiles.RangeFile(row["path"]) as file:
                    shard = Shard(file.read(row["offset"], row["bytes"]))
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths.astype(np.int64))
                starts = ends - shard.lengths
                sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=shard.null.astype(bool)), pa.array(row["before"] + starts), pa.array(shard.lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    places = shard_places(spark, path).repartition(shuffle_partitions(spark), "part", "offset")
    return places.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``(doc_id, ids)`` of the documents named, each decoded as a range of its shard; shards without any are not expanded."""
    ship(spark)
    wanted = np.unique(np.array(doc_ids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with binfiles.RangeFile(row["path"]) as file:
                    shard = Shard(file.read(row["offset"], row["bytes"]))
                found = np.flatnonzero(np.isin(shard.doc_ids, wanted) & (shard.null == 0)).tolist()
                ids = pa.array([shard.document(k).tolist() for k in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[found], pa.int64()), ids], ["doc_id", "ids"])

    return shard_places(spark, path).repartition(shuffle_partitions(spark), "part", "offset").mapInArrow(run, "doc_id long, ids array<long>")


def encode_and_read_back(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and return what ``read_shards`` finds there.

    An empty table gives an empty result; repeated rows are documents of their own; columns other than doc_id and
    text are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    write_shards(docs, tokenizer, path)
    return read_shards(spark, path)
