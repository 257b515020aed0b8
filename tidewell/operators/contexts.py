"""Context windows around hits: sentences, anchors, merged ranges and overlapping splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions import arrays
from tidewell.session import materialise

#: Fixed values of the context windows.
BEFORE, AFTER, MOST_SENTENCES, SENTENCE_STEP = 4, 4, 16, 12
CHARS_BEFORE, CHARS_AFTER, CHAR_SIZE, CHAR_STEP = 1000, 1000, 11200, 10000
CAP_SIZE, CAP_STEP = 12000, 11600

#: A sentence runs to a full stop, question or exclamation mark with closing quotes, or to a line's end.
SENTENCE = r"(?U)[^\s][^\n]*?(?:[.!?…]+[\"'”’)\]]*(?=\s|$)|(?=\n|$))"


def sentence_spans(text: Column) -> Column:
    """``array<{start, end}>`` of sentences by a rule of punctuation and lines, in code points.

    A stand-in for a trained splitter: any array of spans of this form serves the functions below.
    """
    sizes = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.length(s))
    gaps = F.transform(F.split(text, SENTENCE, -1), lambda g: F.length(g))
    return F.when(text.isNull(), F.array().cast("array<struct<start: int, end: int>>")).otherwise(arrays.placed(gaps, sizes))


def anchor(spans: Column, start: Column, end: Column) -> Column:
    """Index of the sentence that a match overlaps first, else of the nearest; the lower index on a tie; null if none."""
    scored = F.transform(
        spans,
        lambda s, i: F.struct(
            (~((s["start"] < end) & (start < s["end"]))).alias("apart"),
            F.when((s["start"] < end) & (start < s["end"]), 0).otherwise(F.when(s["end"] <= start, start - s["end"]).otherwise(s["start"] - end)).alias("gap"),
            i.alias("i"),
        ),
    )
    return F.array_min(scored)["i"]


def merge_ranges(rows: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Ranges of each key merged while a range starts no later than ``gap`` past the largest end so far."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def split_ranges(rows: DataFrame, start: str, end: str, size: int, step: int, inclusive: bool) -> DataFrame:
    """Ranges longer than ``size`` as overlapping windows every ``step``; the last window ends where the range does."""
    one = 1 if inclusive else 0
    length = F.col(end) - F.col(start) + one
    k = F.greatest(F.lit(1), F.ceil((length - size) / step) + 1).cast("int")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), k - 1)))
    low = (F.col(start) + F.col("_i") * step).cast("int")
    return rows.withColumns({"_s": low, "_e": F.least(F.col(end), low + size - one).cast("int")}).drop(start, end, "_i").withColumnsRenamed({"_s": start, "_e": end})


def anchored(rows: DataFrame) -> DataFrame:
    """``(post_id, h, i)`` of every hit of rows (post_id, hits, spans): the hit and its ``anchor``, for spans in order and apart.

    Sentence ends and hits of a post stand in one sorted line, along which each hit sees the last sentence that ends no
    later than it begins, and where the next begins; so a post costs its sentences and hits once, however many there are.
    """
    marks = F.transform(F.sequence(F.lit(-1), F.size("spans") - 1), lambda i: F.struct(i.alias("i"), F.get("spans", i)["end"].alias("end"), F.get("spans", i + 1)["start"].alias("next")))
    none = F.lit(None)
    ends = rows.filter(F.size("spans") > 0).select("post_id", F.explode(marks).alias("mark")).select("post_id", F.coalesce("mark.end", F.lit(-1)).alias("at"), F.lit(0).alias("kind"), "mark", none.cast(rows.schema["hits"].dataType.elementType).alias("h"))
    hits = rows.select("post_id", F.explode("hits").alias("h")).select("post_id", F.col("h.match_start").cast("int").alias("at"), F.lit(1).alias("kind"), none.cast(ends.schema["mark"].dataType).alias("mark"), "h")
    line = Window.partitionBy("post_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ends.unionByName(hits).withColumn("mark", F.last("mark", ignorenulls=True).over(line)).filter("kind = 1")
    before, after = F.col("h.match_start") - F.col("mark.end"), F.col("mark.next") - F.col("h.match_end")
    stays = F.col("mark.next").isNull() | ((F.col("mark.i") >= 0) & (after >= 0) & (before <= after))
    return met.select("post_id", "h", F.when(stays, F.col("mark.i")).otherwise(F.col("mark.i") + 1).alias("i"))


def _prepared(posts: DataFrame, spans: Column | None) -> tuple[DataFrame, DataFrame]:
    """Posts that have hits, with their sentences, written once as every step reads them; and their anchored hits."""
    own = sentence_spans(F.col("text")) if spans is None else spans
    base = materialise(posts.filter(F.size("hits") > 0).select("post_id", "text", "hits", own.alias("spans")), "sentences")
    sizes = base.select("post_id", F.size("spans").alias("k"), F.length("text").alias("n"))
    hits = anchored(base.select("post_id", "hits", "spans")).withColumn("i", F.coalesce("i", F.lit(0)))
    return base, materialise(hits.join(sizes, "post_id"), "anchors")


def _by_sentence(hits: DataFrame) -> DataFrame:
    around = hits.filter("k > 1").select("post_id", F.greatest(F.lit(0), F.col("i") - BEFORE).alias("s"), F.least(F.col("k") - 1, F.col("i") + AFTER).alias("e")).distinct()
    return split_ranges(merge_ranges(around, ["post_id"], "s", "e", 1), "s", "e", MOST_SENTENCES, SENTENCE_STEP, True)


def _by_chars(hits: DataFrame) -> DataFrame:
    near = hits.filter("k <= 1").select("post_id", F.greatest(F.lit(0), F.col("h.match_start") - CHARS_BEFORE).alias("s"), F.least(F.col("n"), F.col("h.match_end") + CHARS_AFTER).alias("e"))
    return split_ranges(merge_ranges(near, ["post_id"], "s", "e", 0), "s", "e", CHAR_SIZE, CHAR_STEP, False)


def _cut() -> Column:
    return F.trim(F.col("text").substr(F.col("a") + 1, F.col("b") - F.col("a")))


def chunks(posts: DataFrame, spans: Column | None = None) -> DataFrame:
    """``(post_id, chunk_index, chunk)``: the text around each post's hits.

    Posts of more than one sentence take ``BEFORE`` and ``AFTER`` sentences around each hit's anchor, merged where
    they touch and split where long; others take characters. Chunks over ``CAP_SIZE`` characters are split again.
    Input: post_id, text and hits (array of structs with match_start and match_end). Chunk indexes count from 0 in
    order of place, blank chunks included in the count but not in the result.
    """
    base, hits = _prepared(posts, spans)
    places = base.select("post_id", "spans").join(_by_sentence(hits), "post_id").select("post_id", F.get("spans", F.col("s"))["start"].alias("a"), F.get("spans", F.col("e"))["end"].alias("b"))
    places = places.unionByName(_by_chars(hits).select("post_id", F.col("s").alias("a"), F.col("e").alias("b")))
    index = F.row_number().over(Window.partitionBy("post_id").orderBy("a", "b")) - 1
    cut = split_ranges(places, "a", "b", CAP_SIZE, CAP_STEP, False).withColumn("chunk_index", index).join(base.select("post_id", "text"), "post_id")
    return cut.select("post_id", "chunk_index", _cut().alias("chunk")).filter("chunk <> ''")


def contexts(posts: DataFrame, spans: Column | None = None) -> DataFrame:
    """``(post_id, start_sentence_idx, end_sentence_idx, text, term_ids, hit_spans)``: contexts as rows that keep their hits.

    As ``chunks``, but ranges stay whole sentences (no cap in characters), blank ones are kept, and each context holds the
    sorted terms and the hits whose sentence lies in it (for texts of one sentence or none: that overlap it).
    """
    base, hits = _prepared(posts, spans)
    meta = hits.select("post_id", F.struct("h.match_start", "h.match_end", "h.term_id", F.col("i").alias("sentence_index")).alias("m"))

    def held(ranges: DataFrame, inside: Column) -> DataFrame:
        return ranges.join(meta, "post_id").filter(inside).groupBy("post_id", "s", "e").agg(F.array_sort(F.collect_set("m.term_id")).alias("term_ids"), F.array_sort(F.collect_list("m")).alias("hit_spans"))

    names = ["post_id", "start_sentence_idx", "end_sentence_idx"]
    rows = held(_by_sentence(hits), F.col("m.sentence_index").between(F.col("s"), F.col("e"))).join(base, "post_id")
    a = rows.select("post_id", F.col("s").alias(names[1]), F.col("e").alias(names[2]), F.get("spans", F.col("s"))["start"].alias("a"), F.get("spans", F.col("e"))["end"].alias("b"), "text", "term_ids", "hit_spans")
    rows = held(_by_chars(hits), (F.col("m.match_end") > F.col("s")) & (F.col("m.match_start") < F.col("e"))).join(base, "post_id")
    b = rows.select("post_id", F.lit(0).alias(names[1]), F.lit(0).alias(names[2]), F.col("s").alias("a"), F.col("e").alias("b"), "text", "term_ids", "hit_spans")
    return a.unionByName(b).select(*names, _cut().alias("text"), "term_ids", "hit_spans")


def relocated(rows: DataFrame, near: int = 200) -> DataFrame:
    """Adds ``place`` {start, end} of a hit in rewritten text to rows (original, rewritten, match_start, match_end, term_name).

    The hit's words near the expected place, else anywhere, else the term itself, all without regard to case; else a
    place in proportion. Native: each search is a ``locate`` in lower-cased text.
    """
    words = F.col("original").substr(F.col("match_start") + 1, F.col("match_end") - F.col("match_start"))
    low, n = F.lower("rewritten"), F.length("rewritten")
    scale = n / F.greatest(F.lit(1), F.length("original"))
    guess = F.floor(F.col("match_start") * scale).cast("int")
    # the first occurrence from the near side on counts if it ends within the far side
    begin = F.greatest(F.lit(0), guess - near)

    def found(what: Column, after: Column, stop: Column) -> Column:
        at = F.call_function("locate", F.lower(what), low, after + 1) - 1
        return F.when((F.length(what) > 0) & (at >= 0) & (at + F.length(what) <= stop), F.struct(at.alias("start"), (at + F.length(what)).alias("end")))

    last = F.least(guess, F.greatest(F.lit(0), n - 1))
    share = F.greatest(F.lit(1), F.floor((F.col("match_end") - F.col("match_start")) * scale).cast("int"))
    zero = F.lit(0)
    place = F.coalesce(found(words, begin, guess + near + F.length(words)), found(words, zero, n), found(F.col("term_name"), zero, n), F.struct(last.alias("start"), F.least(n, last + share).alias("end")))
    return rows.withColumn("place", place)


def resolve(rows: DataFrame, rewrite=None, batch: int = 8, longest: int = 12000) -> DataFrame:
    """Adds ``text_coreference_resolved``; ``rewrite(list[str]) -> list[str]`` is injected, the identity by default.

    Texts over ``longest`` characters raise. If a batch fails its texts are tried one by one, and one that fails
    again keeps its original.
    """
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out: list[str] = []
        values = ["" if t is None else t for t in texts]
        if any(len(t) > longest for t in values):
            raise ValueError("text is longer than the resolver takes")
        for at in range(0, len(values), batch):
            part = values[at : at + batch]
            try:
                out += rewrite(part)
            except Exception:
                for t in part:
                    try:
                        out += rewrite([t])
                    except Exception:
                        out.append(t)
        return pd.Series(out)

    return rows.withColumn("text_coreference_resolved", F.col("text") if rewrite is None else run("text"))
