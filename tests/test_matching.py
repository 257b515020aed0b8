"""Spans of many terms, lexemes and the kept index, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import stem
from tidewell.operators import automaton, index, matching
from tidewell.session import scratch

WORDS = "flu shot vaccine vaccines vaccinated running runs ran the and été ÉTÉ straße İzmir ısı Kelvin ΣΟΦΟΣ σοφός 😀 dose dosing doses".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def bodies():
    rng = random.Random(4)
    out = [None, "", " ", "FLU flu Flu", "aaaa", "the and", "ſhot SHOT", "Kelvin"]
    return out + [prose(rng, n) for n in (1, 3, 10, 40, 200, 3000)] + ["flu shot"] * 3


@pytest.fixture(scope="module")
def posts(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies, 1)), "post_id long, text string")


def terms_of(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "term_id string, name string")


def test_spans_of_ten_thousand_terms(spark, posts, bodies):
    rng = random.Random(5)
    names = ["flu", "FLU", "", None, "aa", "shot", "kelvin", "été", "straße", "σοφος", "ısı", "x.*"]
    names += ["".join(rng.choice("aeftluhosdgr ") for _ in range(rng.randint(2, 6))).strip() for _ in range(10_000)]
    got = sorted((r[0], int(r[1]), r[2], r[3]) for r in matching.span_hits(posts, terms_of(spark, names)).collect())
    want = []
    for k, body in enumerate(bodies, 1):
        own = automaton.folded(body or "")
        for j, n in enumerate(names):
            at = own.find(automaton.folded(n)) if n else -1
            while at >= 0:
                want.append((k, j, at, at + len(n)))
                at = own.find(automaton.folded(n), at + len(n))
    assert got == sorted(want) and len({x[1] for x in got}) > 500


def test_folding_is_that_of_patterns_without_case():
    # every letter against the lower and the upper form of itself, as the standard library's patterns see them
    for code in (*range(0x20, 0x600), *range(0x1E00, 0x2200), 0x212A, 0x1E9E, 0x10400, 0x10428):
        c = chr(code)
        assert len(automaton.folded(c + "é")) == 2
        for other in {c.lower(), c.upper()}:
            if len(other) == 1 and re.fullmatch(re.escape(c), other, re.I):
                assert automaton.folded("é" + c) == automaton.folded("é" + other), (c, other)


def plain_candidates(bodies, names, stemmed, after=0):
    have = lambda s: {stem.stem(x) if stemmed else x for x in re.findall(r"[^\W_]+", (s or "").lower()) if x not in stem.STOP_WORDS}
    return {(k, j) for k, b in enumerate(bodies, 1) for j, n in enumerate(names) if k > after and have(n) and have(n) <= have(b)}


NAMES = ["vaccine", "the vaccines", "run", "dose vaccine flu", "the", "", "unknown", "été flu", "shots"]


@pytest.mark.parametrize("stemmed", [True, False])
def test_index_equals_the_scan_and_reads_new_posts_only(spark, posts, bodies, stemmed):
    want = plain_candidates(bodies, NAMES, stemmed)
    t = terms_of(spark, NAMES)
    scan = {(r[0], int(r[1])) for r in matching.candidates(posts, t, stemmed).collect()}
    assert scan == want and want
    kept = index.Index(spark, scratch(spark, "index"), stemmed, block=4)
    assert kept.candidates(t).count() == 0 and kept.cursor == 0
    for top in (2, 9, 9, len(bodies)):
        # what was indexed before is gone from the table, so a run that read it again would lose it
        seen = kept.cursor
        assert kept.update(posts.filter((F.col("post_id") > seen) & (F.col("post_id") <= top))) == top
        got = {(r[0], int(r[1])) for r in kept.candidates(t).collect()}
        assert got == {x for x in want if x[0] <= top}
    assert {(r[0], int(r[1])) for r in kept.candidates(t, after=9).collect()} == plain_candidates(bodies, NAMES, stemmed, 9)
    rows = kept.postings().collect()
    kept.merge()
    merged = kept.postings().collect()
    assert len({(r["lexeme"], r["block"]) for r in rows}) == len(merged) and sum(r["n"] for r in rows) == sum(r["n"] for r in merged)
    assert {(r[0], int(r[1])) for r in kept.candidates(t).collect()} == want


def test_index_scan_is_pushed_down(spark, posts):
    folder = scratch(spark, "posts")
    posts.write.parquet(folder)
    kept = index.Index(spark, scratch(spark, "index"))
    kept.update(spark.read.parquet(folder).filter("post_id <= 5"))
    plan = spark.read.parquet(folder).filter(F.col("post_id") > kept.cursor)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(post_id,5)" in plan
    kept.update(spark.read.parquet(folder))
    assert "lexeme" in kept.candidates(terms_of(spark, ["flu"]))._jdf.queryExecution().executedPlan().toString()


def test_unfinished_segments_are_not_read(spark, posts):
    kept = index.Index(spark, scratch(spark, "index"))
    kept.update(posts.filter("post_id <= 8"))
    before = kept.candidates(terms_of(spark, NAMES)).count()
    kept._write(spark.createDataFrame([("flu", 0, bytearray(b"\x01"))], "lexeme string, block long, postings binary"))  # a run that failed before its commit
    assert kept.candidates(terms_of(spark, NAMES)).count() == before and kept.cursor == 8


def test_segments_are_merged_when_many(spark, posts, bodies):
    kept = index.Index(spark, scratch(spark, "index"))
    for top in range(1, index.MOST_SEGMENTS + 1):
        kept.update(posts.filter(F.col("post_id") <= top))
    assert len(kept._manifest()[2]) == 1 and kept.cursor == index.MOST_SEGMENTS
    got = {(r[0], int(r[1])) for r in kept.candidates(terms_of(spark, NAMES)).collect()}
    assert got == {x for x in plain_candidates(bodies, NAMES, True) if x[0] <= index.MOST_SEGMENTS}


def test_packed_lists():
    rng = np.random.default_rng(0)
    for own in ([], [0], [0, 1, 2, 127, 128, 16383, 16384, 2**40], np.unique(rng.integers(0, 1 << 30, 5000)).tolist()):
        raw = index.packed(np.array(own, np.int64))
        assert index.unpacked(raw).tolist() == own


def test_incremental_match_with_a_kept_index(spark, posts, bodies):
    t = spark.createDataFrame([(1, "flu shot"), (2, "vaccine"), (3, "été")], "term_id int, name string")
    state = spark.createDataFrame([], "term_id int, matcher_version string, last_post_id long")
    kept = index.Index(spark, scratch(spark, "index"))
    first, state = matching.match(posts.filter("post_id <= 11"), t, state, "v1", "2024-01-01 00:00:00", kept=kept)
    second, state = matching.match(posts, t, state, "v1", "2024-01-02 00:00:00", kept=kept)
    both = sorted((r["post_id"], r["term_id"], r["match_start"]) for r in first.unionByName(second).collect())
    none = spark.createDataFrame([], "term_id int, matcher_version string, last_post_id long")
    whole, _ = matching.match(posts, t, none, "v1", "2024-01-02 00:00:00")
    assert both == sorted((r["post_id"], r["term_id"], r["match_start"]) for r in whole.collect()) and both
    assert {r["last_post_id"] for r in state.collect()} == {len(bodies)} and second.agg(F.min("post_id")).first()[0] > 11
