"""Sentence boundaries with abbreviations and sentence starters learned from the corpus itself.

After Kiss and Strunk (2006): a word type is an abbreviation if it stands before a full stop far more often than chance
and is short, by a scaled log-likelihood ratio; a word starts sentences if it follows sure ends far more often than
chance. What is learned is counted over all rows by word type and kept as two bounded lists. A full stop behind an
abbreviation ends a sentence only where a sentence starter follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import arrays
from tidewell.operators.contexts import SENTENCE
from tidewell.session import materialise

#: Limits of the published method: the least score of an abbreviation and the least likelihood ratio of a starter.
ABBREVIATION, STARTER = 0.3, 30.0
#: Members of each list at most, the highest scores first.
MOST = 2000

_EDGES = r"(?U)^[\p{Ps}\p{Pi}\"']+|[\p{Pe}\p{Pf}\"',;:]+$"
_TYPE = r"(?U)^\p{L}[\p{L}.]*$"
_ENDS = r"[.!?…]$"


@dataclass(frozen=True)
class Marks:
    """What was learned: abbreviations without their last full stop and words that start sentences, in lower case."""

    abbreviations: frozenset[str] = frozenset()
    starters: frozenset[str] = frozenset()


#: Characters that a sentence, or a quotation or bracket behind it, may end with.
_TAILS = tuple(".!?…\"'”’»)]")


def _bare(token: Column) -> Column:
    """A token without brackets and quotes around it."""
    return F.regexp_replace(token, _EDGES, "")


def _pairs(rows: DataFrame, text: str) -> DataFrame:
    """``(before, t, n)``: white-space parts counted with the part before each; ``before`` is empty unless it may end a sentence.

    Parts are counted as they stand, so that everything else is done once for each distinct one.
    """
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " ")), " ")
    tail = lambda b: F.when(F.substring(b, -1, 1).isin(*_TAILS), b).otherwise(F.lit(""))
    both = F.zip_with(F.concat(F.array(F.lit("")), F.slice(parts, F.lit(1), F.size(parts) - 1)), parts, lambda b, t: F.struct(tail(b).alias("before"), t.alias("t")))
    return rows.select(F.explode(both).alias("x")).groupBy("x.before", "x.t").agg(F.count("*").alias("n")).filter("t <> ''")


def _ratio(both: Column, own: Column, other: Column, all_: Column, expected: float | None = None) -> Column:
    """Dunning's log-likelihood ratio (doubled) that ``own`` goes with ``other`` in ``both`` of ``all_`` cases.

    With ``expected`` the alternative is that share, otherwise what is observed with and without ``own``.
    """
    least = F.lit(1e-12)
    bound = lambda p: F.least(F.greatest(p, least), F.lit(1.0) - least)
    said = lambda k, n, p: k * F.log(bound(p)) + (n - k) * F.log(F.lit(1.0) - bound(p))
    chance = other / all_
    if expected is not None:
        return F.lit(-2.0) * (said(both, own, chance) - said(both, own, F.lit(expected)))
    rest, left = all_ - own, other - both
    return F.lit(-2.0) * (said(both, own, chance) + said(left, rest, chance) - said(both, own, both / own) - said(left, rest, left / F.greatest(rest, F.lit(1.0))))


def abbreviation_scores(pairs: DataFrame) -> DataFrame:
    """``(type, score)`` of every word type that stands before a full stop, from ``_pairs``."""
    tokens = pairs.groupBy("t").agg(F.sum("n").alias("n")).select(_bare(F.col("t")).alias("t"), "n")
    stop = F.col("t").endswith(".")
    word = F.lower(F.when(stop, F.regexp_replace("t", r"\.$", "")).otherwise(F.col("t")))
    types = tokens.select(word.alias("type"), F.when(stop, F.col("n")).otherwise(0).alias("stop"), "n").filter(F.col("type").rlike(_TYPE))
    counts = types.groupBy("type").agg(F.sum("stop").alias("with"), F.sum("n").alias("n"))
    total = counts.agg(F.sum("with").alias("stops"), F.sum("n").alias("all")).first()
    stops, all_ = F.lit(float(total["stops"] or 0)), F.lit(float(total["all"] or 1))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    dots = F.length("type") - letters + 1
    ratio = _ratio(F.col("with").cast("double"), F.col("n").cast("double"), stops, all_, 0.99)
    score = ratio * F.exp(-letters) * dots * F.pow(letters, -(F.col("n") - F.col("with")).cast("double"))
    return counts.filter("with > 0").select("type", score.alias("score"))


def starter_ratios(pairs: DataFrame, abbreviations: frozenset[str]) -> DataFrame:
    """``(word, ratio)`` of the words that follow sure ends of sentences more often than chance, in upper case, from ``_pairs``."""
    own = pairs.select(_bare(F.col("before")).alias("before"), _bare(F.col("t")).alias("t"), "n")
    short = F.lower(F.regexp_replace("before", r"\.$", ""))
    sure = F.col("before").rlike(_ENDS) & ~(F.col("before").endswith(".") & (short.isin(*abbreviations) if abbreviations else F.lit(False)) | (F.length(short) < 2))
    upper = F.col("t").rlike(r"(?U)^\p{Lu}")
    word = F.lower(F.regexp_replace("t", r"(?U)[^\p{L}].*$", ""))
    of = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    counts = own.groupBy(word.alias("word")).agg(F.sum("n").alias("n"), of(sure).alias("sure"), of(sure & upper).alias("first"))
    total = counts.agg(F.sum("n").alias("all"), F.sum("sure").alias("ends")).first()
    all_, ends = F.lit(float(total["all"] or 1)), F.lit(float(total["ends"] or 0))
    first, n = F.col("first").cast("double"), F.col("n").cast("double")
    return counts.filter("word <> '' AND first > 0").filter(first / n > ends / all_).select("word", _ratio(first, n, ends, all_).alias("ratio"))


def learn(rows: DataFrame, text: str = "text", most: int = MOST) -> Marks:
    """Abbreviations and starters of all texts of ``rows``; at most ``most`` of each come to the driver."""
    top = lambda df, name, by, least: frozenset(r[0] for r in df.filter(F.col(by) >= least).orderBy(F.desc(by), name).limit(most).select(name).collect())
    pairs = materialise(_pairs(rows, text), "pairs")
    abbreviations = top(abbreviation_scores(pairs), "type", "score", ABBREVIATION)
    return Marks(abbreviations, top(starter_ratios(pairs, abbreviations), "word", "ratio", STARTER))


def split(text: Column, marks: Marks) -> Column:
    """``array<{start, end}>`` of sentences in code points: the ends of ``contexts.sentence_spans`` but for those that the
    full stop of an abbreviation, or of a single letter, makes where no sentence starter follows on the same line."""
    within = lambda x, names: x.isin(*sorted(names)) if names else F.lit(False)
    first = lambda p: F.lower(F.regexp_extract(p, r"(?U)^[^\p{L}\s]*(\p{L}+)", 1))

    def short(piece: Column) -> Column:
        """Whether ``piece`` ends with an abbreviation or a single letter and its full stop."""
        last = F.lower(F.regexp_replace(F.regexp_extract(piece, r"(?U)(\S+)\.$", 1), _EDGES, ""))
        known = arrays.let(last, lambda w: within(w, marks.abbreviations) | w.rlike(r"(?U)^\p{L}$"))
        return F.when(piece.endswith("."), known).otherwise(F.lit(False))

    def joined(x: Column) -> Column:
        n = F.size(x["spans"])
        # a line feed between two pieces always parts them
        same_line = lambda i: ~F.get(x["seps"], i + 1).contains("\n")
        open_ = lambda p, i: (i < n - 1) & short(p) & same_line(i) & ~within(first(F.get(x["pieces"], i + 1)), marks.starters)
        flags = F.transform(x["pieces"], lambda p, i: F.coalesce(open_(p, i), F.lit(False)))

        def of(flags: Column) -> Column:
            starts = F.filter(x["spans"], lambda s, i: (i == 0) | ~F.get(flags, i - 1))
            ends = F.filter(x["spans"], lambda s, i: ~F.get(flags, i))
            return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))

        return arrays.let(flags, of)

    def placed(x: Column) -> Column:
        spans = arrays.placed(F.transform(x["seps"], lambda g: F.length(g)), F.transform(x["pieces"], lambda p: F.length(p)))
        return arrays.let(F.struct(spans.alias("spans"), x["pieces"].alias("pieces"), x["seps"].alias("seps")), joined)

    # pieces and what stands between them are looked for once
    both = F.struct(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)).alias("pieces"), F.split(text, SENTENCE, -1).alias("seps"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return F.when(text.isNull(), none).otherwise(arrays.let(both, lambda x: F.when(F.size(x["pieces"]) == 0, none).otherwise(placed(x))))
