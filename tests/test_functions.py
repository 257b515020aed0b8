import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import keys, rates, stem, text, times
from tidewell.operators import claims, contexts, ingest, schedule


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("body, term", [("Aab aAB", "aab"), ("😀 the The THE", "the"), ("K kelvin K", "k"), ("a.b a+b", "a.b"), ("none", "zz"), ("", "a"), ("aaa", "aa"), (r"x\Ey \e", r"\E")])
def test_spans_equal_literal_search(spark, body, term):
    want = [(m.start(), m.end()) for m in re.finditer(re.escape(term), body, re.I)]
    assert [tuple(s) for s in one(spark, text.spans(F.lit(body), F.lit(term)))] == want


def test_spans_of_nothing(spark):
    assert one(spark, text.spans(F.lit("abc"), F.lit(""))) == []
    assert one(spark, text.spans(F.lit(None).cast("string"), F.lit("a"))) is None


def test_redact_uses_typed_placeholders(spark):
    got = one(spark, text.redact(F.lit("mail a.b@c.org, call +1 (415) 555-1234, host 10.0.0.1, card 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00")))
    for placeholder in text.PLACEHOLDERS.values():
        assert placeholder in got
    assert "555" not in got and one(spark, text.redact(F.lit(None).cast("string"))) == ""


def test_noise_and_gate(spark):
    assert one(spark, text.strip_noise(F.lit("hi  http://x.y/z @me #tag example.com/p"))) == "hi tag"
    assert one(spark, text.language_gate(F.lit("short"))) is False
    assert one(spark, text.language_gate(F.lit("this is a long enough sentence"))) is True


def test_submission_text(spark):
    assert one(spark, text.submission_text(F.lit("t"), F.lit("b"), F.lit(True))) == "t\nb"
    assert one(spark, text.submission_text(F.lit("t"), F.lit(" [Removed] "), F.lit(True))) == "t"
    assert one(spark, text.submission_text(F.lit("t"), F.lit("b"), F.lit(None).cast("boolean"))) == "t"


@pytest.mark.parametrize("iso, want", [("PT1H2M10S", 3730), ("P1DT1S", 86401), ("PT45S", 45), ("P2W", 1209600), ("PT", None), ("x", None), ("", None), (None, None)])
def test_durations(spark, iso, want):
    assert one(spark, times.duration_seconds(F.lit(iso).cast("string"))) == want


def test_pacific_days(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    assert str(one(spark, times.pacific_day(at("2026-02-13 07:00:00")))) == "2026-02-12"
    assert str(one(spark, times.pacific_day(at("2026-02-13 09:00:00")))) == "2026-02-13"
    assert one(spark, times.next_pacific_midnight(at("2026-02-13 07:00:00"))) == datetime(2026, 2, 13, 8)
    window = one(spark, times.next_session(at("2026-02-13 18:30:00")))
    assert (window["start"], window["end"]) == (datetime(2026, 2, 13, 17), datetime(2026, 2, 13, 20))
    assert one(spark, times.next_session(at("2026-02-13 20:00:00")))["start"] == datetime(2026, 2, 14, 2)


def test_ids(spark):
    assert one(spark, keys.submission_id(F.lit(" ab "))) == "t3_ab"
    assert one(spark, keys.parent_comment_id(F.lit("t3_x"))) is None
    for bad in ("t1_x", " ", None):
        with pytest.raises(Exception):
            one(spark, keys.submission_id(F.lit(bad).cast("string")))
    assert one(spark, keys.json_or_text(F.lit("{bad"))) == "{bad"
    assert one(spark, keys.json_or_text(F.lit('{"a": 1}'))) == '{"a":1}'
    assert one(spark, keys.audio_candidates(F.lit("https://t.co/a.mp3"))) == ["https://t.co/a.mp3"]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("vaccines", "vaccin"), ("vaccination", "vaccin"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("dying", "die"), ("knackeries", "knackeri"), ("consolingly", "consol"), ("sky", "sky"), ("relational", "relat"), ("ties", "tie"), ("cries", "cri")])
def test_stems(word, want):
    assert stem.stem(word) == want


def test_lexemes_drop_stop_words(spark):
    rows = spark.createDataFrame([(1, "The vaccines and the VACCINATION"), (2, "the of"), (3, None)], "id int, t string")
    assert {r["id"]: r["lexemes"] for r in stem.lexemes(rows, "id", "t").collect()} == {1: ["vaccin"], 2: [], 3: []}


def test_merge_ranges_equals_a_plain_loop(spark):
    rng = random.Random(5)
    data = [(g, s, s + rng.randint(0, 9)) for g in range(20) for s in (rng.randint(0, 80) for _ in range(rng.randint(1, 12)))]
    want = []
    for g in range(20):
        own = []
        for _, s, e in sorted(x for x in data if x[0] == g):
            if own and s <= own[-1][1] + 1:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        want += [(g, s, e) for s, e in own]
    got = contexts.merge_ranges(spark.createDataFrame(data, "g int, s int, e int"), ["g"], "s", "e", 1)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_split_ranges(spark):
    got = contexts.split_ranges(spark.createDataFrame([(0, 39), (0, 15), (5, 21)], "s int, e int"), "s", "e", 16, 12, inclusive=True)
    assert sorted(map(tuple, got.collect())) == [(0, 15), (0, 15), (5, 20), (12, 27), (17, 21), (24, 39)]


def test_sentences_and_anchor(spark):
    body = 'One two. "Three?" Four\nFive'
    spans = one(spark, contexts.sentence_spans(F.lit(body)))
    assert [body[s["start"] : s["end"]] for s in spans] == ["One two.", '"Three?"', "Four", "Five"]
    at = lambda s, e: one(spark, contexts.anchor(contexts.sentence_spans(F.lit(body)), F.lit(s), F.lit(e)))
    assert at(0, 3) == 0 and at(10, 12) == 1 and at(8, 9) == 0
    assert one(spark, contexts.anchor(contexts.sentence_spans(F.lit("")), F.lit(0), F.lit(1))) is None


def test_chunks_hold_their_hits(spark):
    body = " ".join(f"Sentence {k} ends here." for k in range(60))
    at = body.index("Sentence 30")
    posts = spark.createDataFrame([(1, body, [(at, at + 8)]), (2, "x" * 5000, [(2500, 2501)])], "post_id long, text string, hits array<struct<match_start: int, match_end: int>>")
    got = {(r["post_id"], r["chunk_index"]): r["chunk"] for r in contexts.chunks(posts).collect()}
    assert got[1, 0].startswith("Sentence 26") and got[1, 0].endswith("Sentence 34 ends here.") and len(got[2, 0]) == 2001


def test_relocated(spark):
    rows = spark.createDataFrame([("he took the shot", "the man took the shot", 12, 16, "shot"), ("abc", "zzzz", 0, 1, "q")], "original string, rewritten string, match_start int, match_end int, term_name string")
    a, b = (r["place"] for r in contexts.relocated(rows.coalesce(1)).collect())
    assert tuple(a) == (17, 21) and b["end"] <= 4


def test_budget_rejections_do_not_count(spark):
    e = spark.createDataFrame([("d", 1, 60), ("d", 2, 60), ("d", 3, 40), ("e", 1, 101)], "day string, seq int, units int")
    got = [(r["day"], r["seq"], r["accepted"], r["used"]) for r in schedule.charge(e, 100).orderBy("day", "seq").collect()]
    assert got == [("d", 1, True, 60), ("d", 2, False, 60), ("d", 3, True, 100), ("e", 1, False, 0)]


def test_slots_in_the_middle_of_their_buckets(spark):
    got = one(spark, schedule.slots(F.lit(100.0), F.lit(100.0), 4))
    assert [round(x, 6) for x in got] == [111.25, 133.75, 156.25, 178.75]


def test_backfill_windows():
    plan = schedule.Backfill(datetime(2026, 3, 1))
    assert plan.after(True).days == 15 and plan.after(True).after(True).after(True).days == 7
    clean = plan.after(False)
    assert clean.end == plan.window[0] + schedule.Backfill.OVERLAP and clean.days == 60 and clean.after(False).days == 90


def test_rates(spark):
    assert one(spark, rates.revisit_seconds(F.lit(0.0), F.lit(0))) == 21600
    assert one(spark, rates.scrapes_a_day(F.lit(0), F.lit(5.0))) == 4
    assert one(spark, rates.ewma(F.array(F.lit(2.0), F.lit(4.0)))) == pytest.approx(2.6)


def test_insert_absent_counts(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    got = ingest.insert_absent(batch, spark.createDataFrame([(2,)], "k int"), ["k"], [F.col("v")])
    assert [tuple(r) for r in got.rows.collect()] == [(1, "a")] and (got.inserted, got.skipped) == (1, 3)


def test_align_and_jobs(spark):
    with pytest.raises(ValueError):
        ingest.align(spark.range(1), spark.range(1), ["name"])
    jobs = spark.createDataFrame([(3, "a", None)], "id long, name string, description string")
    assert ingest.get_or_create(jobs, "a")[1] == 3 and ingest.get_or_create(jobs, "b")[1] == 4


def test_extraction_with_an_injected_model(spark):
    def call(body):
        if body == "bad":
            raise RuntimeError("content_filter")
        return '```json\n{"claims": [{"claim": "c", "claim_stance_to_vaccines": "pro"}]}\n```' if body == "ok" else '{"x": 1}'

    rows = claims.extract(spark.createDataFrame([("ok",), ("bad",), ("odd",)], "input_text string"), call)
    got = {r["input_text"]: r["claim_extraction_disposition"] for r in rows.collect()}
    assert got == {"ok": "success", "bad": "terminal_failure", "odd": "retryable_failure"}
