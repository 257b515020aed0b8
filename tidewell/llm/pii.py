"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field adds spans that the patterns' exact form misses (a phone number without
a plus sign, an address spelled with "at" and "dot"): around digits and address marks, text becomes tokens, every run
of at most ``MAX_TOKENS`` tokens with a plausible beginning, end and content is a candidate segment, features look at
whole segments, and bounded-entity dynamic programming chooses boundaries and kinds jointly. Segments whose posterior
reaches ``POSTERIOR`` and that touch no base span are added.

The field is fitted on base spans of a bounded sample (``FIT_DOCS`` documents that have some), each also in rewritten
forms; extraction covers every whole text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.session import ship

KINDS = ("email", "ip", "card", "phone")
#: Documents of the fit, and the characters that each has at most.
FIT_DOCS, FIT_CHARS = 600, 20_000
#: Examples that the fit takes of them, drawn by seed.
FIT_EXAMPLES = 3000
MAX_TOKENS = 24
POSTERIOR = 0.8

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Each begins with a literal or a set of characters, so that scanning a text is cheap.
_ANCHORS = tuple(map(re.compile, (r"[0-9@]+", r"[(\[](?:at|dot)[)\]]", r" at\s+[A-Za-z0-9-]+(?=\.[A-Za-z0-9]|\s+dot\b)", r" dot\b")))
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a match begins where the run of local characters before it does."""
    out, at, least = [], text.find("@"), 0
    while at >= 0:
        local = text[least:at]
        start = least + len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        least = found.end() if found else at + 1
        at = text.find("@", least)
    return out


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern matches, sorted; kind is an index into ``KINDS``."""
    if not text:
        return []
    spans = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m.group())) <= 15]
    return sorted(spans)


_TOKENS = re.compile(rf"(?:{_TOKEN.pattern}){{0,{MAX_TOKENS}}}")


def _before(text: str, at: int) -> int:
    """Where the ``MAX_TOKENS`` tokens before ``at`` begin."""
    width = 256
    while True:
        part = text[max(0, at - width) : at][::-1]
        length = _TOKENS.match(part).end()
        if length < len(part) or len(part) < width:
            return at - length
        width *= 2


def regions(text: str, near: int = 24) -> Iterator[tuple[int, int]]:
    """Ranges of text around anchors that reach as many tokens to either side as a segment may have, so that every
    segment with an anchor lies within one range; ranges that meet are one."""
    runs: list[list[int]] = []
    for left, right in sorted(m.span() for p in _ANCHORS for m in p.finditer(text)):
        if runs and left - runs[-1][1] <= near:
            runs[-1][1] = max(runs[-1][1], right)
        else:
            runs.append([left, right])
    start = stop = None
    for left, right in runs:
        left, right = _before(text, left), _TOKENS.match(text, right).end()
        if start is not None and left > stop:
            yield start, stop
            start = None
        start, stop = (left, right) if start is None else (start, max(stop, right))
    if start is not None:
        yield start, stop


_AT = re.compile(r"\s*(?:@|[(\[]at[)\]]|(?<=\s)at(?=\s))\s*")
_DOT = re.compile(r"\s*(?:\.|[(\[]dot[)\]]|(?<=\s)dot(?=\s))\s*")
_ADDRESS = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT.pattern}[A-Za-z0-9_%+-]+)*{_AT.pattern}[A-Za-z0-9-]+(?:{_DOT.pattern}[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]*[0-9][0-9\s().+-]*[0-9]")


def _bounds(text: str) -> list[int]:
    """Where the tokens of ``text`` begin, and its end."""
    return [m.start() for m in _TOKEN.finditer(text)] + [len(text)]


def candidates(text: str, bounds: list[int]) -> Iterator[tuple[int, int, str]]:
    """The candidate segments ``(first token, past the last, content)``, by their first token."""
    n = len(bounds) - 1
    kinds = ["s" if text[bounds[k]].isspace() else "d" if text[bounds[k]].isdigit() else "a" if text[bounds[k]].isalnum() else "p" for k in range(n)]
    marks = [k for k in range(n) if text[bounds[k]] == "@" or text[bounds[k] : bounds[k + 1]] == "at"]
    for i in range(n):
        opens = kinds[i] in "da" or text[bounds[i]] in "+("
        if not opens or i and kinds[i] in "da" and kinds[i - 1] in "da":
            continue
        digits = 0
        mark = bisect_right(marks, i)
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            digits += bounds[j] - bounds[j - 1] if kinds[j - 1] == "d" else 0
            if kinds[j - 1] not in "da" or j < n and kinds[j] in "da":
                continue
            content = text[bounds[i] : bounds[j]]
            if digits >= 4 and _NUMBER.fullmatch(content) or mark < len(marks) and marks[mark] < j - 1 and _ADDRESS.fullmatch(content):
                yield i, j, content


def segments(text: str) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Token bounds of ``text`` and all its candidate segments."""
    bounds = _bounds(text)
    return bounds, list(candidates(text, bounds))


_FEATURES = [f"{k}:{f}" for k in KINDS for f in ("bias", "at", "atword", "dot", "dotword", "tld", "plus", "paren", "octets", "dots3", "luhn", "n4", "n7", "n10", "n11", "n14", "n20", "one", "spaces", "prefix4", "groups", "badend", "left", "right", "space")]
_INDEX = {f: k for k, f in enumerate(_FEATURES)}


def features(content: str, before: str, after: str) -> list[int]:
    """Numbers of the properties of a whole segment and its neighbours, without the kind."""
    digits = _NOT_DIGITS.sub("", content)
    n, out = len(digits), ["bias"]
    at = re.search(r"[(\[]at[)\]]|\sat\s", content)
    if "@" in content:
        out.append("at")
    if at:
        out.append("atword")
    if re.search(r"[(\[]dot[)\]]|\sdot\s", content):
        out.append("dotword")
    if "." in content:
        out.append("dot")
    if re.search(r"(?:\.|dot[)\]]?)\s*(?:com|org|net|edu|gov|io|info)$", content):
        out.append("tld")
    if not (at or "@" in content):
        out += [x for x, y in (("plus", content[0] == "+"), ("paren", "(" in content), ("dots3", content.count(".") == 3), ("octets", bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", content)) and _octets(content)), ("luhn", n >= 14 and luhn(digits)), ("one", content.isdigit()), ("spaces", " " in content or "-" in content), ("groups", bool(re.fullmatch(r"(?:\+?[0-9]{1,2}[ -])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", content)))) if y]
        out.append("n4" if n < 7 else "n7" if n < 10 else "n10" if n == 10 else "n11" if n < 14 else "n14" if n < 20 else "n20")
    if before and not before.isspace():
        out.append("left")
    if after and not (after.isspace() or after in ".,;:!?"):
        out.append("right")
    return out


class Field:
    """Weights, and inference over the lattice of a text's candidate segments."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = np.zeros(len(_FEATURES)) if weights is None else weights
        self.cache: dict[tuple[str, str, str], list[float]] = {}

    def scores(self, content: str, before: str, after: str) -> list[float]:
        key = (content, before, after)
        found = self.cache.get(key)
        if found is None:
            names = features(content, before, after)
            found = [sum(self.weights[_INDEX[f"{k}:{f}"]] for f in names) for k in KINDS]
            if len(self.cache) < 20_000:
                self.cache[key] = found
        return found

    def lattice(self, text: str) -> tuple[int, list[tuple[int, int, str, str, str]], list[int]]:
        """Tokens, candidates with their neighbours, and token bounds of the whole text."""
        bounds, found = segments(text)
        rows = [(i, j, c, text[bounds[i] - 1 : bounds[i]], text[bounds[j] : bounds[j] + 1]) for i, j, c in found]
        return len(bounds) - 1, rows, bounds

    def parts(self, text: str) -> Iterator[tuple[list[int], list[tuple[int, int, str, str, str]]]]:
        """``(token bounds, candidates)`` of the stretches of ``text`` that no candidate reaches over: what lies between
        scores nothing, so stretches do not depend on each other, and a long text is never one lattice."""
        bounds = _bounds(text)
        own: list[tuple[int, int, str, str, str]] = []
        first = reach = 0
        for i, j, c in candidates(text, bounds):
            if own and i >= reach:
                yield bounds[first : reach + 1], own
                own = []
            if not own:
                first = i
            reach = max(reach, j) if own else j
            own.append((i - first, j - first, c, text[bounds[i] - 1 : bounds[i]], text[bounds[j] : bounds[j] + 1]))
        if own:
            yield bounds[first : reach + 1], own

    def posteriors(self, text: str) -> tuple[list[tuple[int, int, str, str, str]], list[list[float]], list[int], float]:
        """Candidates, each kind's posterior for each, token bounds, and the log partition sum. Outside tokens score 0."""
        n, rows, bounds = self.lattice(text)
        post, z = self._marginals(rows, n) if rows else ([], 0.0)
        return rows, post, bounds, z

    def _marginals(self, rows: list[tuple[int, int, str, str, str]], n: int) -> tuple[list[list[float]], float]:
        """Posteriors of candidates over ``n`` tokens, and the log partition sum."""
        scores = [self.scores(c, b, a) for _, _, c, b, a in rows]
        ending: dict[int, list[int]] = {}
        starting: dict[int, list[int]] = {}
        for k, (i, j, *_) in enumerate(rows):
            ending.setdefault(j, []).append(k)
            starting.setdefault(i, []).append(k)
        front, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [front[j - 1]] + [front[rows[k][0]] + s for k in ending.get(j, ()) for s in scores[k]]
            front[j] = _logsum(terms)
        for i in range(n - 1, -1, -1):
            terms = [back[i + 1]] + [back[rows[k][1]] + s for k in starting.get(i, ()) for s in scores[k]]
            back[i] = _logsum(terms)
        z = front[n]
        return [[math.exp(front[r[0]] + s + back[r[1]] - z) for s in own] for r, own in zip(rows, scores)], z

    def best(self, text: str) -> list[tuple[int, int, int, float]]:
        """``(start, kind, end, posterior)`` of the segments on the best path."""
        return [x for bounds, rows in self.parts(text) for x in self._path(bounds, rows)]

    def _path(self, bounds: list[int], rows: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, int, float]]:
        n = len(bounds) - 1
        post, _ = self._marginals(rows, n)
        ending: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            ending.setdefault(r[1], []).append(k)
        value, choice = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in ending.get(j, ()):
                own = self.scores(*rows[k][2:])
                kind = max(range(4), key=own.__getitem__)
                if value[rows[k][0]] + own[kind] > value[j]:
                    value[j], choice[j] = value[rows[k][0]] + own[kind], (k, kind)
        out, j = [], n
        while j > 0:
            if choice[j] is None:
                j -= 1
            else:
                k, kind = choice[j]
                out.append((bounds[rows[k][0]], kind, bounds[rows[k][1]], post[k][kind]))
                j = rows[k][0]
        return out[::-1]


def _logsum(terms: list[float]) -> float:
    top = max(terms)
    return top if len(terms) == 1 else top + math.log(sum(math.exp(t - top) for t in terms))


def _examples(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Regions of a training text with their base spans, and rewritten forms of them."""
    spans = base_spans(text)
    for a, b in regions(text):
        own = [(s - a, k, e - a) for s, k, e in spans if a <= s and e <= b]
        free: list[tuple[int, int, int]] = []
        for s, k, e in own:  # overlapping patterns (a card inside a phone) cannot both be segments
            if not free or s >= free[-1][2]:
                free.append((s, k, e))
        region = text[a:b]
        yield region, free
        for s, k, e in free:
            content, others = region[s:e], [x for x in free if x[0] != s]
            forms = []
            if k == 3:
                forms = [content[1:], re.sub(r"^\+[0-9]+[ -]*", "", content), re.sub(r"[ -]", ".", re.sub(r"[()]", "", content[1:]))]
            elif k == 0:
                forms = [content.replace("@", " at ").replace(".", " dot "), content.replace("@", " (at) ").replace(".", " (dot) "), content.replace("@", "[at]").replace(".", "[dot]"), content.replace("@", " at ")]
            elif k == 2 and content.isdigit():
                broken = content[:-1] + str((int(content[-1]) + 5) % 10)
                yield region[:s] + broken + region[e:], others
                forms = [" ".join(content[i : i + 4] for i in range(0, len(content), 4))]
            elif k == 1:
                yield region[:s] + content.replace(".", ".9", 1).replace(".9", ".99") + region[e:], others
            for form in forms:
                moved = len(form) - (e - s)
                yield region[:s] + form + region[e:], [(x, y, z) if z <= s else (x + moved, y, z + moved) for x, y, z in others] + [(s, k, s + len(form))]


def fit(texts: list[str], rounds: int = 12, rate: float = 0.5) -> Field:
    """Conditional likelihood by AdaGrad over the examples of ``texts``; without examples no segment is likely."""
    field = Field()
    for k in KINDS:
        field.weights[_INDEX[f"{k}:bias"]] = -4.0
    data = []
    for text in texts:
        for region, gold in _examples(text):
            bounds, found = segments(region)
            if not found:
                continue
            index = {(bounds[i], bounds[j]): k for k, (i, j, _) in enumerate(found)}
            known = [(index[s, e], k) for s, k, e in gold if (s, e) in index]
            if len(known) == len(gold):
                data.append((region, dict(known)))
    seen = np.full(len(_FEATURES), 1e-3)
    rng = np.random.default_rng(7)
    data = [data[k] for k in rng.permutation(len(data))[:FIT_EXAMPLES]]
    for _ in range(rounds):
        for at in range(0, len(data), 50):
            field.cache.clear()
            grad = -1e-3 * field.weights * 50
            for region, gold in data[at : at + 50]:
                rows, post, _, _ = field.posteriors(region)
                for k, (r, own) in enumerate(zip(rows, post)):
                    names = features(*r[2:])
                    for kind in range(4):
                        d = (gold.get(k) == kind) - own[kind]
                        if abs(d) > 1e-4:
                            for f in names:
                                grad[_INDEX[f"{KINDS[kind]}:{f}"]] += d
            seen += grad * grad
            field.weights = field.weights + rate * grad / np.sqrt(seen)
    field.cache.clear()
    return field


def train(docs: DataFrame) -> Field:
    """Fit on the base spans of the ``FIT_DOCS`` candidate documents of lowest id hash."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter((F.length("text") <= FIT_CHARS) & F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]{14}|[0-9]\.[0-9]+\.[0-9]"))
    # ids are ranked without their texts, so that what tasks send to the driver stays small
    picked = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(FIT_DOCS)
    rows = some.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return fit([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])])


def added_spans(text: str | None, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Segments of the best paths that reach the posterior and touch no base span (``base`` in order), nor each other."""
    starts, ends = [], []  # the base spans' union: ranges in order and apart
    for x, _, z in base:
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(x), ends.append(z)
    out: list[tuple[int, int, int]] = []
    for a, b in regions(text or ""):
        for s, kind, e, p in field.best(text[a:b]):
            s, e = s + a, e + a
            at = bisect_right(ends, s)
            if p < POSTERIOR or at < len(starts) and starts[at] < e:
                continue
            if not any(x < e and s < z for x, _, z in takewhile(lambda o: o[2] > a, reversed(out))):  # those of this region or at its edge
                out.append((s, kind, e))
    return out


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` of every row; no shuffle.

    Counts are of base spans. Null texts are empty, very long ones are searched whole; repeated rows are rows of their own;
    other columns are ignored; no rows, no result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field.weights)

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for text in batch.column(1).slice(at, 512).to_pylist():
                    base = base_spans(text)
                    more = added_spans(text, base, field)
                    out.append((*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
