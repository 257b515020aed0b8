"""Toxic spans and document scores from a linear-chain conditional random field.

The labels mark documents, so token labels are induced first: words and word beginnings that occur in toxic
training documents far more often than chance allows mark their tokens. A two-state chain field is then fitted to the
labelled tokens, with features of each word, of its neighbours and of the step between states; forward-backward marginals
over whole texts give each word's probability of being toxic, spans are runs of words at one half or more, and a logistic
model over the marginals' sum and largest values gives the document's score.

The fit reads a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN`` documents of at most ``MAX_FIT_CHARS``
characters) and from it at most ``TOXIC_PIECES`` and ``CLEAN_PIECES`` pieces of ``SPAN`` words, drawn by seed; scoring
covers every whole text as one chain.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.chunks import Codes
from tidewell.llm.repair import ragged
from tidewell.session import released, ship

#: Bounds of the labelled sample that the model is fitted on.
MAX_TOXIC, MAX_CLEAN, MAX_FIT_CHARS = 1800, 3600, 50_000
#: Pieces that the chain is fitted on at most, drawn by seed from all pieces with a marked word and all of clean documents.
TOXIC_PIECES, CLEAN_PIECES = 4000, 8000
#: Words of a piece. Scoring works through pieces too, but messages pass on from piece to piece.
SPAN = 32
BITS = 18
CACHE = 300_000
THRESHOLD = 0.5
_EDGES = ".,;:!?\"'()[]{}<>*#-_…«»¿¡"
_BREAKS = "\t\r"


def core(chunk: str) -> str:
    return chunk.strip(_EDGES).lower()


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of three to six letters."""
    return [f"={word}", *(f"^{word[:k]}" for k in range(3, 7) if len(word) >= k)]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def features(chunk: str) -> list[int]:
    word = core(chunk)
    shape = ("d" if any(c.isdigit() for c in word) else "a") + ("u" if chunk[:1].isupper() else "l")
    return [_hash(f) >> (32 - BITS) for f in (*word_features(word), f"${word[-3:]}", f"#{shape}")]


class Sample:
    """Training texts as chunk codes; what depends on the chunk alone is computed once per distinct chunk."""

    def __init__(self, texts: list[str]) -> None:
        codes = Codes()
        self.codes, sizes = codes.of(texts, _BREAKS)
        self.codes = self.codes.astype(np.int32)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.chunks = list(codes)
        words = [core(c) for c in self.chunks]
        self.words = np.array([_hash(w) if w else 0 for w in words], np.uint32)
        self.sizes = np.fromiter((1 + max(0, min(6, len(w)) - 2) if w else 0 for w in words), np.int64, len(words))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.features = np.fromiter((_hash(f) for w in words if w for f in word_features(w)), np.uint32, int(self.sizes.sum()))

    def of(self, k: int) -> np.ndarray:
        return self.codes[self.starts[k] : self.ends[k]]

    def apart(self, own: list[int]) -> list[int]:
        """Of ``own`` those without an earlier near copy: one that shares two of four minimum hashes of its word pairs."""
        seen: set[tuple[int, int, int]] = set()
        kept = []
        for k in own:
            words = self.words[self.of(k)].astype(np.uint64)
            hashes = words * np.uint64(31) + np.append(words[1:], np.uint64(0)) * np.uint64(0x9E3779B9)
            lows = [int(((hashes * np.uint64(m)) >> np.uint64(32)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
            pairs = {(i, j, lows[i] << 32 | lows[j]) for i in range(4) for j in range(i)}
            if not pairs & seen:
                kept.append(k)
            seen |= pairs
        return kept

    def frequencies(self, own: list[int]) -> dict[int, int]:
        """In how many of the texts ``own`` each word feature occurs."""
        per_text = []
        for k in own:
            u = np.unique(self.of(k))
            per_text.append(np.unique(self.features[ragged(self.first[u], self.sizes[u])]))
        values, n = np.unique(np.concatenate(per_text or [np.zeros(0, np.uint32)]), return_counts=True)
        return dict(zip(values.tolist(), n.tolist()))

    def marked(self, marks: set[int]) -> np.ndarray:
        """Per distinct chunk, whether any of its features is in ``marks``."""
        hit = np.concatenate(([0], np.cumsum(np.isin(self.features, np.fromiter(marks, np.uint32, len(marks))))))
        return hit[self.first + self.sizes] > hit[self.first]


def toxic_features(toxic: dict[int, int], n: int, clean: dict[int, int], m: int) -> set[int]:
    """Features whose share among ``n`` toxic documents exceeds that among ``m`` clean ones twentyfold, beyond a
    likelihood-ratio bound that allows for the number of candidates."""
    need = 2 * math.log(len(toxic) + 1) + 4
    share = n / (n + m)
    found = set()
    for f, a in toxic.items():
        b = clean.get(f, 0)
        gain = 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))
        if a >= 3 and gain >= need and a / n >= 20 * b / m:
            found.add(f)
    return found


def marginals(e: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Probability of the second state at each place; ``e [time, sequences]`` holds its score against the first's.

    Forward and backward messages are scaled at each step. With ``pairs`` also the expected transitions, summed.
    """
    steps, n = e.shape
    odds = np.exp(np.clip(e, -25, 25))
    t = np.exp(trans)
    front, back = np.empty((steps, n), e.dtype), np.empty((steps, n), e.dtype)
    p = odds[0] / (1 + odds[0])
    front[0] = p
    for k in range(1, steps):
        q = 1 - p
        one = (q * t[0, 1] + p * t[1, 1]) * odds[k]
        p = one / (one + q * t[0, 0] + p * t[1, 0])
        front[k] = p
    b = np.full(n, 0.5, e.dtype)
    back[-1] = b
    for k in range(steps - 2, -1, -1):
        w = b * odds[k + 1]
        zero, one = t[0, 0] * (1 - b) + t[0, 1] * w, t[1, 0] * (1 - b) + t[1, 1] * w
        b = one / (zero + one)
        back[k] = b
    one = front * back
    out = one / (one + (1 - front) * (1 - back))
    if not pairs:
        return out
    a0, a1, b0, b1 = 1 - front[:-1], front[:-1], 1 - back[1:], back[1:] * odds[1:]
    cells = [[a0 * t[0, 0] * b0, a0 * t[0, 1] * b1], [a1 * t[1, 0] * b0, a1 * t[1, 1] * b1]]
    total = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
    return out, np.array([[(cells[i][j] / total).sum() for j in (0, 1)] for i in (0, 1)])


def text_marginals(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray, span: int = SPAN) -> np.ndarray:
    """``marginals`` of chains of any length: ``e`` holds their scores one chain after the other.

    Chains are cut into pieces of ``span`` steps. Each piece's steps multiply to one matrix, for all pieces at once; messages
    pass over these matrices from piece to piece, and then through the steps of all pieces at once.
    """
    own = lengths[lengths > 0]
    if not len(own):
        return np.zeros(0, e.dtype)
    pieces = -(-own // span)
    first = np.cumsum(pieces) - pieces
    step = ragged(np.zeros(len(own), np.int64), own)
    row, column = step % span, np.repeat(first, own) + step // span
    n = int(pieces.sum())
    odds, used = np.ones((span, n), e.dtype), np.zeros((span, n), bool)
    odds[row, column], used[row, column] = np.exp(np.clip(e, -25, 25)), True
    t = np.exp(trans).astype(e.dtype)
    begins = np.zeros(n, bool)
    begins[first] = True
    a, b, c, d = np.ones(n, e.dtype), np.zeros(n, e.dtype), np.zeros(n, e.dtype), np.ones(n, e.dtype)
    for k in range(span):
        x = (a * t[0, 0] + b * t[1, 0], (a * t[0, 1] + b * t[1, 1]) * odds[k], c * t[0, 0] + d * t[1, 0], (c * t[0, 1] + d * t[1, 1]) * odds[k])
        if k == 0:  # the first word of a text follows no other
            x = (np.where(begins, 1, x[0]), np.where(begins, 0, x[1]), np.where(begins, 0, x[2]), np.where(begins, odds[0], x[3]))
        scale = x[0] + x[1] + x[2] + x[3]
        a, b, c, d = (np.where(used[k], y / scale, z) for y, z in zip(x, (a, b, c, d)))
    into, after = np.full(n, 0.5, e.dtype), np.full(n, 0.5, e.dtype)
    order = np.argsort(-pieces, kind="stable")
    most, begin = pieces[order], first[order]
    for j in range(1, int(most[0])):
        at = begin[: np.searchsorted(-most, -j, "left")] + j  # texts with more than j pieces
        p = into[at - 1]
        zero, one = (1 - p) * a[at - 1] + p * c[at - 1], (1 - p) * b[at - 1] + p * d[at - 1]
        into[at] = one / (zero + one)
    for j in range(int(most[0]) - 1, 0, -1):
        at = begin[: np.searchsorted(-most, -j, "left")] + j
        p = after[at]
        zero, one = a[at] * (1 - p) + b[at] * p, c[at] * (1 - p) + d[at] * p
        after[at - 1] = one / (zero + one)
    front = np.empty((span, n), e.dtype)
    p = into
    for k in range(span):
        zero, one = (1 - p) * t[0, 0] + p * t[1, 0], ((1 - p) * t[0, 1] + p * t[1, 1]) * odds[k]
        if k == 0:
            zero, one = np.where(begins, 1, zero), np.where(begins, odds[0], one)
        p = np.where(used[k], one / (zero + one), p)
        front[k] = p
    out = np.empty((span, n), e.dtype)
    p = after
    for k in range(span - 1, -1, -1):
        both = front[k] * p
        out[k] = both / (both + (1 - front[k]) * (1 - p))
        w = p * odds[k]
        zero, one = t[0, 0] * (1 - p) + t[0, 1] * w, t[1, 0] * (1 - p) + t[1, 1] * w
        p = np.where(used[k], one / (zero + one), p)
    return out[row, column]


@dataclass
class Model:
    """Weights of hashed features, transition scores, and the document model's bias and weights."""

    weights: np.ndarray
    trans: np.ndarray
    document: np.ndarray


class Features:
    """Numbers of the features of distinct chunks: their own, and what they tell as the chunk before or after."""

    def __init__(self, chunks: list[str]) -> None:
        lists = [features(c) if c else [] for c in chunks]
        self.sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.index = np.fromiter((i for x in lists for i in x), np.int64, int(self.sizes.sum()))
        self.starts = np.cumsum(self.sizes) - self.sizes
        words = [core(c) for c in chunks]
        self.before, self.after = (np.fromiter((_hash(m + w) >> (32 - BITS) for w in words), np.int64, len(words)) for m in "<>")

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per chunk the score of its own features, and of it as the chunk before and after another."""
        own = np.zeros(len(self.sizes), weights.dtype)
        some = np.flatnonzero(self.sizes)
        if len(some):
            own[some] = np.add.reduceat(weights[self.index], self.starts[some])
        return own, weights[self.before], weights[self.after]


def _fit_chain(known: Features, codes: np.ndarray, before: np.ndarray, after: np.ndarray, y: np.ndarray, rounds: int = 45, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Conditional likelihood of the labelled pieces ``[time, pieces]`` by Adam over all of them; code 0 is no chunk."""
    flat = codes.ravel()
    sizes = known.sizes[flat] + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    index = np.empty(int(sizes.sum()), np.int64)
    index[ragged(starts, sizes - 2)] = known.index[ragged(known.starts[flat], sizes - 2)]
    index[ends - 2], index[ends - 1] = known.before[before.ravel()], known.after[after.ravel()]
    w, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    seen = np.array([[((1 - y[:-1]) * (1 - y[1:])).sum(), ((1 - y[:-1]) * y[1:]).sum()], [(y[:-1] * (1 - y[1:])).sum(), (y[:-1] * y[1:]).sum()]])
    state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(trans), np.zeros_like(trans)]]
    n = y.size
    for step in range(1, rounds + 1):
        e = np.add.reduceat(w[index], starts).reshape(y.shape)
        p, pairs = marginals(e, trans, pairs=True)
        grads = [np.bincount(index, np.repeat((y - p).ravel(), sizes), 1 << BITS) / n - l2 * w, (seen - pairs) / n]
        for x, g, (m, v) in zip((w, trans), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.4 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w.astype(np.float32), trans


def neighbours(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes before and after each, within texts of ``lengths``; 0 where there is none."""
    before, after = np.concatenate(([0], codes))[: len(codes)], np.concatenate((codes[1:], [0]))[: len(codes)]
    ends = np.cumsum(lengths)[lengths > 0]
    before[ends - lengths[lengths > 0]], after[ends - 1] = 0, 0
    return before, after


class Scorer:
    """Applies a model to whole texts; what depends on a chunk alone is computed once per distinct chunk."""

    def __init__(self, model: Model, cache: int = CACHE) -> None:
        self.model, self.cache = model, cache
        self.clear()

    def clear(self) -> None:
        self.codes = Codes()
        self.score = np.zeros((3, 1 << 12), np.float32)
        self._learn(0, [""])

    def _learn(self, known: int, chunks: list[str]) -> None:
        while known + len(chunks) > self.score.shape[1]:
            self.score = np.concatenate((self.score, np.zeros_like(self.score)), axis=1)
        self.score[:, known : known + len(chunks)] = Features(chunks).scores(self.model.weights)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(p, starts, sizes)``: marginals of all chunks of all texts; text k has ``p[starts[k] :][: sizes[k]]``.

        Empty chunks are no words: they have probability 0 and no place in the chain.
        """
        if len(self.codes) > self.cache:
            self.clear()
        codes, sizes = self.codes.of(texts, _BREAKS)
        if self.codes.new:
            self._learn(len(self.codes) - len(self.codes.new), self.codes.new)
            self.codes.new.clear()
        starts = np.cumsum(sizes) - sizes
        used = np.flatnonzero(codes)
        lengths = np.add.reduceat((codes != 0).astype(np.int64), starts)
        before, after = neighbours(codes[used], lengths)
        own, as_before, as_after = self.score
        p = np.zeros(len(codes), np.float32)
        p[used] = text_marginals(own[codes[used]] + as_before[before] + as_after[after], lengths, self.model.trans)
        return p, starts, sizes

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text ``[log1p(sum), largest, second largest]`` of its marginals, with the marginals and starts."""
        p, starts, _ = self.words(texts)
        total = np.add.reduceat(p, starts)
        largest = np.maximum.reduceat(p, starts)
        rest = p.copy()
        where = np.flatnonzero(p >= 0.01)
        owner = np.searchsorted(starts, where, "right") - 1
        first = {}
        for i, k in zip(where.tolist(), owner.tolist()):
            if k not in first and p[i] == largest[k]:
                first[k] = i
        rest[list(first.values())] = 0
        return np.column_stack((np.log1p(total), largest, np.maximum.reduceat(rest, starts))), p, starts

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and spans ``{start, end, score}`` in code points of the words at one half or more."""
        x, p, starts = self.evidence(texts)
        scores = 1 / (1 + np.exp(-np.clip(self.model.document[0] + x @ self.model.document[1:], -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        where = np.flatnonzero(p >= THRESHOLD)
        owner = np.searchsorted(starts, where, "right") - 1
        places: dict[int, list[int]] = {}
        for i, k in zip(where.tolist(), owner.tolist()):
            places.setdefault(k, []).append(i - int(starts[k]))
        for k, indices in places.items():
            chunks = texts[k].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            ends = np.cumsum([len(c) + 1 for c in chunks]) - 1
            before = -2
            for i in indices:
                chunk = chunks[i]
                left = int(ends[i]) - len(chunk)
                start = left + len(chunk) - len(chunk.lstrip(_EDGES))
                end = max(left + len(chunk.rstrip(_EDGES)), start)
                score = float(p[starts[k] + i])
                if before == i - 1:
                    spans[k][-1] |= {"end": end, "score": max(score, spans[k][-1]["score"])}
                else:
                    spans[k].append({"start": start, "end": end, "score": score})
                before = i
        return scores, spans


def _pieces(sample: Sample, marked: np.ndarray, toxic: list[int], clean: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, the codes before and after, and labels of the fit's pieces, each ``[time, pieces]`` and padded with code 0."""
    draw = np.random.default_rng(17)

    def words(k: int) -> np.ndarray:
        own = sample.of(k)
        return own[own != 0]

    def cut(own: list[int], most: int, only_marked: bool) -> list[tuple[int, int]]:
        every = [(k, at) for k in own for c in (words(k),) for at in range(0, len(c), SPAN) if not only_marked or marked[c[at : at + SPAN]].any()]
        return [every[i] for i in draw.permutation(len(every))[:most].tolist()]

    bad, good = cut(toxic, TOXIC_PIECES, True), cut(clean, CLEAN_PIECES, False)
    out = np.zeros((3, SPAN, len(bad) + len(good)), np.int64)
    for n, (k, at) in enumerate(bad + good):
        own = words(k)
        for x, part in zip(out, (own, *neighbours(own, np.array([len(own)])))):
            x[: len(part[at : at + SPAN]), n] = part[at : at + SPAN]
    tags = marked[out[0]] & (out[0] != 0)
    tags[:, len(bad) :] = False
    return out[0], out[1], out[2], tags.astype(np.float64)


def fit(rows: list[tuple[str, int]], prior: float) -> Model:
    """The model from labelled ``(text, 0 or 1)`` rows; ``prior`` is the share of label 1 among all training rows.

    Without rows of both labels, scores are the prior for every text.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    empty = Model(np.full(1 << BITS, -3, np.float32), np.zeros((2, 2)), np.array([math.log(prior / (1 - prior)), 0, 0, 0]))
    sides = [[k for k, (_, y) in enumerate(rows) if y == side] for side in (0, 1)]
    if not all(sides):
        return empty
    sample = Sample([t for t, _ in rows])
    clean, toxic = (sample.apart(own) for own in sides)
    marks = toxic_features(sample.frequencies(toxic), len(toxic), sample.frequencies(clean), len(clean))
    if not marks:
        return empty
    *codes, tags = _pieces(sample, sample.marked(marks), toxic, clean)
    known, places = np.unique(np.array([np.zeros_like(codes[0]), *codes]), return_inverse=True)  # code 0 stays 0
    chunks = [sample.chunks[c] for c in known]
    del sample
    weights, trans = _fit_chain(Features(chunks), *places.reshape(4, *tags.shape)[1:], tags)
    model = Model(weights, trans, empty.document)
    scorer = Scorer(model)
    y = np.array([label for _, label in rows], np.float64)
    x = np.concatenate([scorer.evidence([t for t, _ in rows[at : at + 500]])[0] for at in range(0, len(rows), 500)])
    cost = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    design = np.column_stack((np.ones(len(y)), x))
    theta = empty.document.copy()
    for _ in range(30):  # Newton steps of a ridge-penalised logistic fit
        q = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (cost * (y - q)) - 0.05 * np.array([0, 1, 1, 1]) * theta
        curve = (design * (cost * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ design + np.diag([1e-6, 0.05, 0.05, 0.05])
        theta = theta + np.clip(np.linalg.solve(curve, gradient), -2, 2)
    model.document = theta
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on labelled rows of ``docs`` whose crc32 of doc_id leaves a remainder other than 0 by 5.

    The sample takes the rows of lowest id hash in each class up to the module's bounds. Documents labelled more
    than once count as label 1 if any row says so; repeated documents count once. Null texts are not sampled, nor rows
    without an id or label; without rows of both labels the model gives every text the share of label 1.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("doc_id", F.lit(17)), F.col("doc_id")]
    picked = known.filter("y = 1").orderBy(*order).limit(MAX_TOXIC).union(known.filter("y = 0").orderBy(*order).limit(MAX_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= MAX_FIT_CHARS)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return _fitted(rows, float(share) if share is not None else 0.0)


def _fitted(rows: DataFrame, prior: float) -> Model:
    """``fit`` over the bounded rows (doc_id, y, text) in one task, so that the driver gets the model alone."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(text, y) for batch in batches for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        model = fit(sample, prior)
        parts = [pa.array([np.asarray(x, t).tobytes()], pa.binary()) for x, t in ((model.weights, "<f4"), (model.trans, "<f8"), (model.document, "<f8"))]
        yield pa.RecordBatch.from_arrays(parts, ["weights", "trans", "document"])

    found = rows.repartition(1).sortWithinPartitions("doc_id").select("y", "text").mapInArrow(released(run), "weights binary, trans binary, document binary").first()
    if found is None:  # no rows, no task
        return fit([], prior)
    return Model(np.frombuffer(found[0], "<f4"), np.frombuffer(found[1], "<f8").reshape(2, 2), np.frombuffer(found[2], "<f8"))


SPANS = "array<struct<start: int, end: int, score: double>>"


def _apply(rows: DataFrame, model: Model, schema, text, keep) -> DataFrame:
    """``rows`` through ``keep(batch, scores, spans)``; ``text(batch)`` is the column to score."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield keep(part, *scorer.documents(text(part).to_pylist()))

    return rows.mapInArrow(released(run), schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, spans)`` of every row of ``docs``. No shuffle.

    Null texts count as empty, whose score is that of no evidence. Very long texts are one chain, repeated rows are rows of
    their own with equal scores, other columns are ignored, and an empty table gives an empty result.
    """

    def keep(part: pa.RecordBatch, scores: np.ndarray, spans: list) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores.astype(np.float64)), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(rows, model, f"doc_id long, score double, spans {SPANS}", lambda part: part.column(1), keep)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are, whatever their names.

    Null and empty texts are scored like others, very long ones as one chain; repeated rows stay or go together.
    """
    row = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    place = docs.columns.index("text")

    def keep(part: pa.RecordBatch, scores: np.ndarray, spans: list) -> pa.RecordBatch:
        return part.filter(pa.array(scores < threshold))

    return _apply(row, model, row.schema, lambda part: part.column(0).field(place).cast(pa.string()), keep).select("row.*")
