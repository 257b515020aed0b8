"""English lexemes: tokens, a stop list and the published Porter2 (Snowball English) rules.

The stemmer runs once per distinct token of a batch; the stop list and token classes approximate a full-text parser's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.session import ship

TOKEN = r"(?U)[\p{L}\p{N}']+"
#: Stop words of English: fixed values.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Exceptional forms of the published rules: fixed values.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable_at_end(word: str) -> bool:
    return bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.removeprefix("'")
    w = re.sub(r"(^|[aeiouy])y", lambda m: m.group(1) + "Y", w)
    prefix = re.match("gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _region(w, 0)
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if re.search(f"[{_V}]", w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_syllable_at_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            w = w[: -len(end)] + new if len(w) - len(end) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable_at_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens that are no stop words; null text has none."""
    all_ = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit("'")))
    return F.array_except(F.array_distinct(all_), F.array(F.lit(""), *(F.lit(w) for w in sorted(STOP_WORDS))))


def lexemes_of(text: str | None, stemmed: bool = True) -> list[str]:
    """The distinct lexemes of one short text, as ``tokens`` and ``stem`` give them, sorted."""
    import regex

    found = {t.strip("'") for t in regex.findall(r"[\p{L}\p{N}']+", (text or "").lower())} - STOP_WORDS - {""}
    return sorted({stem(t) for t in found} if stemmed else found)


def coded(tokens: pa.Array, stemmed: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """``(row, code, names)`` of an array of token lists: each row's distinct lexemes as codes into ``names``.

    Each distinct token of the array is stemmed once.
    """
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
    words = pc.list_flatten(tokens).dictionary_encode()
    names = words.dictionary.to_pylist()
    row, code = np.repeat(np.arange(len(tokens), dtype=np.int64), sizes), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if stemmed:
        stems: dict[str, int] = {}
        place = np.fromiter((stems.setdefault(stem(w), len(stems)) for w in names), np.int64, len(names))
        names = list(stems)
        pairs = np.unique(row * max(1, len(names)) + place[code]) if len(names) else row[:0]
        row, code = pairs // max(1, len(names)), pairs % max(1, len(names))
    return row, code, names


def lexemes(rows: DataFrame, key: str, text: str, stemmed: bool = True) -> DataFrame:
    """``(key, lexemes)``: the distinct lexemes of each row's text, sorted."""
    own = rows.select(F.col(key), F.array_sort(tokens(F.col(text))).alias("lexemes"))
    if not stemmed:
        return own
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, names = coded(batch.column(1))
            ranks = np.argsort(np.argsort(np.array(names, object))) if names else np.zeros(0, np.int64)
            order = np.lexsort((ranks[code], row))
            values = pa.array(names, pa.string()).take(pa.array(code[order]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], [key, "lexemes"])

    return own.mapInArrow(run, own.schema)
