"""The language detector, scored redaction and learned sentences, against plain Python and held-out rows."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.functions import language, redaction, text
from tidewell.operators import contexts, sentences
from tidewell.session import table

# language -----------------------------------------------------------------------------------------------------------


def plain_words(body):
    return [w for w in re.findall(r"[^\W\d_]+", body.lower())]


def plain_posterior(rows, body, longest=3, smoothing=0.5):
    counts = {}
    for lang, own in rows:
        if lang is not None:
            c = counts.setdefault(lang, Counter())
            for w in plain_words(own or ""):
                c.update(language.grams_of(w, longest))
    kept = set().union(*counts.values())
    score = {}
    for lang, c in counts.items():
        total = c.total() + smoothing * len(kept)
        score[lang] = sum(math.log((c[g] + smoothing) / total) for w in plain_words(body) for g in language.grams_of(w, longest)) / longest
    top = max(score.values())
    e = {k: math.exp(v - top) for k, v in score.items()}
    return {k: v / sum(e.values()) for k, v in e.items()}


def test_posterior_equals_plain_python(spark):
    rows = [("en", "the cat and the dog went to the house " * 3), ("de", "der Hund und die Katze gehen nach Hause, größer"), ("en", None), (None, "ignored words"), ("fr", "le chat et le chien")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    bodies = ["the dog and the house of the cat went", "die Katze und der Hund gehen größer", "le chien et le chat et le chien", "qqqq zzzz xxxx wwww kkkk", "short", "12345 67890 12345 67890 12345", None, "a b c d the see http://x.org/the-the-the @dog"]
    data = spark.createDataFrame([(k, b, "old") for k, b in enumerate(bodies)], "id int, text string, detected string")
    got = {r["id"]: r for r in language.detect(data, model).collect()}
    for k in (0, 1, 2, 3):
        want = plain_posterior(rows, bodies[k])
        best = max(want, key=want.get)
        assert got[k]["confidence"] == pytest.approx(want[best], abs=1e-9)
        assert got[k]["detected"] == (best if want[best] >= language.MIN_CONF else None)
    assert [got[k]["detected"] for k in (0, 1, 2)] == ["en", "de", "fr"]
    assert all(got[k]["detected"] is None and got[k]["confidence"] is None for k in (4, 5, 6, 7))
    none = language.train(spark.createDataFrame([], "lang string, text string"))
    assert {r["detected"] for r in language.detect(data, none).collect()} == {None}


def test_detector_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("lang IS NOT NULL")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.train(docs.filter(~held_out))
    rows = language.detect(docs.filter(held_out), model).select("lang", "detected", "n_chars").collect()
    judged = [r for r in rows if r["detected"] is not None]
    right = sum(r["lang"] == r["detected"] for r in judged)
    assert len(judged) > 0.9 * sum(r["n_chars"] > 100 for r in rows) and right > 0.97 * len(judged)
    label = language.labeller(model)(docs.select(F.col("doc_id").alias("post_id"), "text"))
    assert label.columns == ["post_id", "is_en"] and {r["is_en"] for r in label.collect()} >= {True, False}


# redaction ----------------------------------------------------------------------------------------------------------


def weight(spans):
    return sum((e - s) * round(1000 * p) for s, e, _, p in spans), sum(e - s for s, e, *_ in spans), -len(spans)


def test_chosen_spans_weigh_most_of_all_choices():
    rng = random.Random(6)
    for _ in range(300):
        found = sorted({(s := rng.randint(0, 20), s + rng.randint(1, 8), rng.choice("ab"), rng.choice([0.35, 0.5, 0.6, 1.0])) for _ in range(rng.randint(0, 9))})
        best = max(
            (c for n in range(len(found) + 1) for c in itertools.combinations(found, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(c, 2))),
            key=weight,
        )
        got = redaction.chosen(found)
        assert weight(got) == weight(best) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


CASES = [
    ("mail a.b@c.org now", "mail [REDACTED_EMAIL] now"),
    ("card 4111 1111 1111 1111, not 4111 1111 1111 1112", "card [REDACTED_CREDIT_CARD], not 4111 1111 1111 1112"),
    ("DE89 3704 0044 0532 0130 00", "[REDACTED_IBAN]"),
    ("DE88 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"),
    ("host 10.0.0.1 or 300.1.1.1", "host [REDACTED_IP] or 300.1.1.1"),
    ("host fe80::1ff:fe23:4567:890a ok", "host [REDACTED_IP] ok"),
    ("at 12:30:45 sharp", "at 12:30:45 sharp"),
    ("call (415) 555-1234 or +44 20 7946 0958.", "call [REDACTED_PHONE] or [REDACTED_PHONE]."),
    ("ssn 078-05-1120, 000-05-1120", "ssn [REDACTED], 000-05-1120"),
    ("my bank account is 12345678901", "my bank account is [REDACTED]"),
    ("in total 12345678901 people", "in total 12345678901 people"),
    ("passport no X12345678", "passport no [REDACTED]"),
    ("", ""),
    (None, ""),
]


def test_scores_checks_and_context(spark):
    rows = spark.createDataFrame([(k, a, 1) for k, (a, _) in enumerate(CASES)], "id int, text string, entities int")
    got = {r["id"]: r for r in redaction.redact(rows).collect()}
    assert {k: got[k]["redacted"] for k in got} == {k: want for k, (_, want) in enumerate(CASES)}
    assert [(e["kind"], e["score"]) for e in got[1]["entities"]] == [("card", 1.0)] and got[9]["entities"][0]["score"] == pytest.approx(0.4)
    skipped = {r["id"]: r["redacted"] for r in redaction.redact(rows, skip=("email",), threshold=0.7).collect()}
    assert skipped[0] == CASES[0][0] and skipped[4] == CASES[4][0] and skipped[2] == "[REDACTED_IBAN]"


# sentences ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    nouns = "dose study doctor nurse clinic report virus week parent child".split()
    out = []
    for _ in range(400):
        parts = []
        for _ in range(6):
            body = " ".join(rng.choice(nouns) for _ in range(rng.randint(3, 7)))
            mid = rng.choice(["", f" by dr. {rng.choice(nouns).title()}", f" in approx. {rng.randint(2, 90)} cases", f" (fig. {rng.randint(1, 9)})"])
            parts.append(f"{rng.choice(['The', 'It', 'This', 'They'])} {body}{mid} {rng.choice(nouns)}{rng.choice('..?!')}")
        out.append(" ".join(parts))
    return spark.createDataFrame([(k, t) for k, t in enumerate(out)], "id int, text string")


@pytest.fixture(scope="module")
def marks(corpus):
    return sentences.learn(corpus)


def test_abbreviations_and_starters_are_learned(marks):
    assert {"dr", "approx", "fig"} <= marks.abbreviations and not marks.abbreviations & {"dose", "study", "virus", "child"}
    assert {"the", "it", "this", "they"} <= marks.starters and not marks.starters & {"dose", "virus"}


def cut(spark, body, marks):
    spans = spark.range(1).select(sentences.split(F.lit(body), marks).alias("s")).first()["s"]
    return [body[s["start"] : s["end"]] for s in spans]


def test_abbreviations_do_not_end_sentences(spark, marks):
    assert cut(spark, "We saw dr. Smith there. It was fine.", marks) == ["We saw dr. Smith there.", "It was fine."]
    assert cut(spark, "In approx. 9 cases. J. Doe and the dr. The end!", marks) == ["In approx. 9 cases.", "J. Doe and the dr.", "The end!"]
    assert cut(spark, "See the dr.\nsmall line. 😀 (fig. 2) ok?  Yes", marks) == ["See the dr.", "small line.", "😀 (fig. 2) ok?", "Yes"]
    assert cut(spark, "", marks) == [] and cut(spark, " \n ", marks) == [] and cut(spark, "no stop", marks) == ["no stop"]
    assert spark.range(1).select(F.size(sentences.split(F.lit(None).cast("string"), marks))).first()[0] == 0


def test_nothing_learned_is_the_rule_alone_but_for_single_letters(spark, corpus):
    none = sentences.Marks()
    same = corpus.select(sentences.split(F.col("text"), none).alias("a"), contexts.sentence_spans(F.col("text")).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
    assert same.count() == 0
    assert sentences.learn(corpus.limit(0)) == none


def test_learned_sentences_are_exact_places(corpus, marks):
    rows = corpus.select("text", sentences.split(F.col("text"), marks).alias("s")).collect()
    assert all(len(r["s"]) == 6 for r in rows)
    for r in rows:
        assert " ".join(r["text"][s["start"] : s["end"]] for s in r["s"]) == r["text"]


def test_scores_follow_the_published_ratio(spark):
    rows = spark.createDataFrame([("dr. x dr. y dr. z end. more words here and there end",)], "text string")
    got = {r["type"]: r["score"] for r in sentences.abbreviation_scores(sentences._pairs(rows, "text")).collect()}
    tokens = "dr. x dr. y dr. z end. more words here and there end".split()
    n, stops = len(tokens), 4
    p = stops / n
    for word, with_stop, without in (("dr", 3, 0), ("end", 1, 1)):
        c = with_stop + without
        chance = with_stop * math.log(p) + without * math.log(1 - p)
        want = -2 * (chance - with_stop * math.log(0.99) - without * math.log(0.01))
        assert got[word] == pytest.approx(want * math.exp(-len(word)) * 1 * len(word) ** -without)


def test_links_are_cut_part_by_part(spark):
    cases = {
        "see http://a.b/c d": "see d",
        "x (https://a.b) y": "x ( y",
        "go www.site.org/x?y now": "go now",
        "at sub.site.org/path now": "at now",
        "a/b.c/d e": "a/ e",
        "and/or 3.5 3/4 a.b": "and/or 3.5 3/4 a.b",
        "odd..host.org/x .x/y": "odd.. .x/y",
        "WWW.X.ORG #tag @me_1 end": "tag end",
    }
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select("a", "b", text.strip_noise(F.col("a")).alias("c")).collect()
    assert {r["a"]: r["c"] for r in rows} == cases
