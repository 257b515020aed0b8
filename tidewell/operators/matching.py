"""Matching taxonomy terms to posts: a lexeme prefilter, and exact spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.functions import stem, text
from tidewell.operators import automaton, index
from tidewell.session import materialise, ship


def super_terms(terms: DataFrame, name: str = "name") -> DataFrame:
    """Terms that some other term with fewer words is contained in, by words.

    A contained term's words are all in the other, so terms meet on each term's word that the fewest terms have.
    """
    words = F.array_distinct(F.split(text.normal_term(F.trim(F.col(name))), r"\s+"))
    a = terms.select(F.col(name), words.alias("w"))
    exploded = a.select(name, F.explode("w").alias("word"))
    rare = exploded.join(exploded.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy(name).agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    b = a.join(rare, name).select(F.col("w").alias("bw"), "word")
    pairs = a.select(name, "w", F.explode("w").alias("word")).join(b, "word")
    return pairs.filter((F.size("w") > F.size("bw")) & (F.size(F.array_except("bw", "w")) == 0)).select(name).distinct()


def effective_terms(terms: DataFrame, name: str = "name") -> DataFrame:
    return terms.join(super_terms(terms, name), name, "left_anti")


def _wanted(terms: DataFrame, stemmed: bool) -> Iterator[tuple[list, dict[str, list[int]], list[int]]]:
    """Terms in parts: their ids, which of them want each lexeme, and how many lexemes each wants (never none)."""
    for part in automaton.parts(terms):
        ids, want, need = [], {}, []
        for term_id, name in part:
            own = stem.lexemes_of(name, stemmed)
            if own:
                for x in own:
                    want.setdefault(x, []).append(len(ids))
                ids.append(term_id)
                need.append(len(own))
        yield ids, want, need


def candidates(posts: DataFrame, terms: DataFrame, stemmed: bool = True, key: str = "post_id", body: str = "text") -> DataFrame:
    """``(post_id, term_id)`` where the post has all lexemes of the term; a term of stop words only matches nothing.

    The lexemes that terms want go along to the posts, which are not shuffled: of a batch of posts each distinct token is
    stemmed once, tokens that no term wants are left, and a term is met where as many of its lexemes are found as it has.
    """
    spark = posts.sparkSession
    ship(spark)
    rows = posts.select(F.col(key), stem.tokens(F.col(body)).alias("_tokens"))
    schema = posts.select(key).schema.add(terms.schema["term_id"])
    found = [_candidates_of(rows, part, schema, stemmed) for part in _wanted(terms, stemmed)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _candidates_of(rows: DataFrame, part: tuple[list, dict[str, list[int]], list[int]], schema, stemmed: bool) -> DataFrame:
    shared, id_type = rows.sparkSession.sparkContext.broadcast(part), to_arrow_type(schema[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_ids, want, need = shared.value
        ids, need = pa.array(term_ids, id_type), np.array(need, np.int64)
        for batch in batches:
            row, code, names = stem.coded(batch.column(1), stemmed)
            # each wanted lexeme of the batch with the terms that want it, end to end
            lists = [want.get(x, ()) for x in names]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((t for x in lists for t in x), np.int64, int(sizes.sum()))
            have = sizes[code] > 0
            row, code = row[have], code[have]
            starts = np.cumsum(sizes) - sizes
            times = sizes[code]
            within = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            pairs, n = np.unique(np.repeat(row, times) * max(1, len(need)) + flat[np.repeat(starts[code], times) + within], return_counts=True)
            met = pairs[n == need[pairs % max(1, len(need))]] if len(need) else pairs[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(met // max(1, len(need)))), ids.take(pa.array(met % max(1, len(need))))], schema.names)

    return rows.mapInArrow(run, schema)


def span_hits(posts: DataFrame, terms: DataFrame, key: str = "post_id", body: str = "text") -> DataFrame:
    """``(post_id, term_id, match_start, match_end)`` of every literal occurrence, whatever the lexemes."""
    return automaton.span_hits(posts, terms, key, body)


def live_filter(rows: DataFrame, typed: str, column: str = "name") -> DataFrame:
    """Rows whose ``column`` in lower case matches what was typed, as a pattern; all rows if that is blank."""
    wanted = typed.strip().lower()
    return rows.filter(F.coalesce(F.lower(column).rlike(wanted), F.lit(False))) if wanted else rows


def hits_by_platform(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """Hits and distinct posts by the platform that the registry has for them."""
    return hits.join(registry.select(F.col("id").alias("post_id"), "platform"), "post_id").groupBy("platform").agg(F.count("*").alias("hits"), F.countDistinct("post_id").alias("posts"))


def match(posts: DataFrame, terms: DataFrame, state: DataFrame, version: str, as_of: str, stemmed: bool = True, kept: index.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """``(hits, new state)`` of an incremental run.

    Each term looks at posts with ids after its cursor for ``version`` up to the largest id there is; the new
    cursor is that id. Hits need both the lexeme prefilter and a literal span. With a ``kept`` index of lexemes the
    prefilter reads that (brought up to date first, from new posts only), otherwise it reads the posts after the lowest cursor.
    """
    mine = state.filter(F.col("matcher_version") == version).select("term_id", "last_post_id")
    due = materialise(terms.join(mine, "term_id", "left").withColumn("last_post_id", F.coalesce("last_post_id", F.lit(0).cast("long"))), "due")
    low = due.agg(F.min("last_post_id")).first()[0]
    top = posts.agg(F.coalesce(F.max("post_id"), F.lit(0))).first()[0]
    fresh = posts.filter(F.col("post_id") > F.lit(low if low is not None else 0))
    if kept is None:
        met = candidates(fresh, due, stemmed)
    else:
        kept.update(posts)
        met = kept.candidates(due, after=low or 0)
    met = met.join(due.select("term_id", "last_post_id"), "term_id").filter("post_id > last_post_id").select("post_id", "term_id").distinct()
    rows = span_hits(fresh, due).join(met, ["post_id", "term_id"], "left_semi")
    hits = rows.select("post_id", "term_id", "match_start", "match_end", F.lit(as_of).cast("timestamp").alias("matched_at"), F.lit(version).alias("matcher_version"))
    moved = due.select("term_id", F.lit(version).alias("matcher_version"), F.greatest("last_post_id", F.lit(top).cast("long")).alias("last_post_id"))
    return hits.dropDuplicates(["post_id", "term_id", "match_start", "match_end"]), state.join(moved, ["term_id", "matcher_version"], "left_anti").select("term_id", "matcher_version", "last_post_id").unionByName(moved)


def posts_with_hits(posts: DataFrame, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Posts that have hits, each with the sorted array ``hits`` of ``{match_start, match_end, term_id, term_name}``."""
    named = hits.join(terms.select("term_id", F.col("name").alias("term_name")), "term_id")
    nested = named.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("match_start", "match_end", "term_id", "term_name"))).alias("hits"))
    return posts.join(nested, "post_id")
