"""Personal data found by scored recognisers, chosen by weighted interval scheduling and replaced by typed placeholders.

A recogniser has a pattern with a score, may have a check (digits that must agree, ranges) that makes its finds certain or
drops them, and words that make a find likelier where one stands shortly before it. Of finds that overlap those are kept
that cover the most, each character weighed by the score of its find.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.functions.text import PLACEHOLDERS
from tidewell.session import ship

#: Least score of a find that is replaced, what a word before it adds, and what it then has at least: fixed values.
THRESHOLD, CONTEXT, LEAST_WITH_CONTEXT = 0.35, 0.35, 0.4
#: Words before a find that are looked at, and the characters that these are looked for in.
_WORDS, _REACH = 5, 80
#: What kinds without a placeholder of their own become.
OTHER = "[REDACTED]"


def luhn(digits: str) -> bool:
    """Whether the check digit of ``digits`` is right."""
    own = [int(c) for c in digits][::-1]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def _card(found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)


def _iban(found: str) -> bool:
    own = re.sub(r"[ -]", "", found).upper()
    return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _ipv4(found: str) -> bool:
    return all(int(part) < 256 for part in found.split("."))


def _ipv6(found: str) -> bool:
    groups = [g for g in found.split(":") if g]
    return found.count("::") < 2 and (len(groups) == 8 or "::" in found and len(groups) < 8) and any(c.isdigit() for c in found)


def _ssn(found: str) -> bool:
    area, group, serial = re.split(r"[- ]", found)
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Recogniser:
    """A kind of personal data: pattern and score; a check's result decides alone where there is one and it is ``certain``."""

    kind: str
    pattern: str
    score: float
    check: Callable[[str], bool] | None = None
    certain: bool = True
    words: tuple[str, ...] = ()
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def finds(self, text: str) -> Iterator[tuple[int, int, str, float]]:
        for m in self.compiled.finditer(text):
            score = self.score
            if self.check is not None:
                if not self.check(m.group()):
                    continue
                score = 1.0 if self.certain else score
            if score < 1.0 and self.words:
                before = re.findall(r"\w+", text[max(0, m.start() - _REACH) : m.start()].lower())[-_WORDS:]
                if any(w in before for w in self.words):
                    score = min(1.0, max(score + CONTEXT, LEAST_WITH_CONTEXT))
            yield m.start(), m.end(), self.kind, score


RECOGNISERS = (
    Recogniser("email", r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", 1.0),
    Recogniser("iban", r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}\b", 0.5, _iban),
    Recogniser("card", r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])", 0.3, _card),
    Recogniser("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", 0.6, _ipv4, certain=False),
    Recogniser("ip", r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", 0.6, _ipv6, certain=False),
    Recogniser("phone", r"(?<![\w.])\+\d{1,3}[ .()-]*(?:\d[ .()-]*){6,12}\d(?!\w)", 0.5, words=("phone", "call", "cell", "mobile", "fax", "tel", "number", "reach")),
    Recogniser("phone", r"(?<![\w.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", 0.4, words=("phone", "call", "cell", "mobile", "fax", "tel", "number", "reach")),
    Recogniser("ssn", r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])", 0.5, _ssn, certain=False, words=("ssn", "social", "security")),
    Recogniser("bank", r"(?<![\w.-])\d{8,17}(?![\w-])", 0.05, words=("account", "bank", "acct", "iban", "konto")),
    Recogniser("passport", r"(?<!\w)[A-Z]?\d{8,9}(?!\w)", 0.05, words=("passport",)),
    Recogniser("licence", r"(?<!\w)[A-Z]\d{6,12}(?!\w)", 0.05, words=("licence", "license", "driver", "driving", "dl")),
)


def finds(text: str, threshold: float = THRESHOLD, skip: Collection[str] = (), recognisers: tuple[Recogniser, ...] = RECOGNISERS) -> list[tuple[int, int, str, float]]:
    """``(start, end, kind, score)`` of everything that reaches ``threshold``; of the same place and kind the best score."""
    best: dict[tuple[int, int, str], float] = {}
    for r in recognisers:
        if r.kind not in skip:
            for start, end, kind, score in r.finds(text):
                if score >= threshold:
                    best[start, end, kind] = max(score, best.get((start, end, kind), 0.0))
    return sorted((*k, v) for k, v in best.items())


def chosen(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of ``found`` those that do not overlap and weigh most together: length by score, in thousandths.

    Of choices of equal weight that which covers more, then that of fewer spans.
    """
    own = sorted(found, key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in own]
    value: list[tuple[int, int, int]] = [(0, 0, 0)]
    before = [bisect_right(ends, x[0], 0, k) for k, x in enumerate(own)]
    for k, (start, end, _, score) in enumerate(own):
        weight, covered, fewer = value[before[k]]
        value.append(max(value[k], (weight + (end - start) * round(1000 * score), covered + end - start, fewer - 1)))
    out, k = [], len(own)
    while k:
        if value[k] == value[k - 1]:
            k -= 1
        else:
            out.append(own[k - 1])
            k = before[k - 1]
    return out[::-1]


def redacted(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], PLACEHOLDERS.get(kind, OTHER)]
        at = end
    return "".join([*out, text[at:]])


def redact(rows: DataFrame, text: str = "text", threshold: float = THRESHOLD, skip: Collection[str] = ()) -> DataFrame:
    """``rows`` with ``redacted`` (the text with placeholders) and ``entities`` (an array of start, end, kind and score).

    Null and empty texts give the empty string and no entities. Columns of these names are replaced.
    """
    ship(rows.sparkSession)
    kept = rows.drop("redacted", "entities")
    entity = T.StructType.fromDDL("start int, end int, kind string, score double")
    schema = T.StructType([*kept.schema.fields, T.StructField("redacted", T.StringType()), T.StructField("entities", T.ArrayType(entity))])
    kind, place, skip = to_arrow_type(schema["entities"].dataType), kept.columns.index(text), tuple(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, entities = [], []
            for value in batch.column(place):
                own = value.as_py() or ""
                spans = chosen(finds(own, threshold, skip)) if own else []
                texts.append(redacted(own, spans) if spans else own)
                entities.append([dict(zip(("start", "end", "kind", "score"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(entities, kind)], schema.names)

    return kept.mapInArrow(run, schema)
