"""Similar documents against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidewell.llm import similar

SCHEMA = "doc_id long, text string, row string, digest string, node int, k int"
WORDS = [f"w{k}" for k in range(400)] + ["Größe", "data"]


def shingles(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(texts):
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    return label


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(41)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([6, 40, 200, 600]))) for _ in range(40)]
    out = [None, "", " \n", "one two", "One  two", "one two three"]
    for t in base:
        n = len(t.split())
        out += [t, t, t.upper(), edited(rng, t, max(1, n // 60)), edited(rng, t, max(1, n // 30)), edited(rng, t, n // 12), t + " " + rng.choice(base)]
    chain = base[3]
    for _ in range(12):  # each near the one before, the last far from the first
        chain = edited(rng, chain, max(1, len(chain.split()) // 70))
        out.append(chain)
    rng.shuffle(out)
    return out


def test_one_of_each_class_stays(spark, texts):
    docs = spark.createDataFrame([(k, t, "r", "d", 1, 2) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    got = similar.drop_similar(docs)
    first = {}
    for k, c in enumerate(plain_classes(texts)):
        first.setdefault(c, k)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())


def test_ids_that_repeat_or_lack(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h"), (7, "g h"), (7, "g h"), (9, "x y"), (9, "z"), (3, "z")]
    docs = spark.createDataFrame([(i, t, "r", "d", 1, 2) for i, t in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["text"]) for r in similar.drop_similar(docs).collect())
    assert got == [("3", "z"), ("7", "g h"), ("9", "x y"), ("None", "a b c d e f")]
    assert similar.drop_similar(docs.limit(0)).count() == 0


def test_large_groups_are_dealt_in_parts(spark):
    rng = random.Random(43)
    base = " ".join(rng.choice(WORDS) for _ in range(150))
    texts = [edited(rng, base, 1) for _ in range(90)]
    for _ in range(40):  # walks away from the group, so that many texts do not join its first
        texts.append(edited(rng, texts[-1], 2))
    sets = [similar.shingle_set(t.encode()) for t in texts]
    fps = similar.majority(np.concatenate(sets), np.array([len(s) for s in sets]))
    rows = [(0, k, int(f.view(np.int64)), [int(x) for x in s.view(np.int64)]) for k, (f, s) in enumerate(zip(fps, sets))]
    members = spark.createDataFrame(rows, "component long, node long, fp long, set array<long>").repartition(3)
    want = plain_classes(texts)
    for chunk in (16, 2048):
        from tidewell.llm.components import connected_components

        dealt = members.drop("component").join(similar.sized(members.select("node", "component"), chunk), "node").cache()
        got = {r["node"]: r["component"] for r in connected_components(similar.verified(dealt, 0.8)).collect()}
        mine = [got.get(k, k) for k in range(len(texts))]
        assert [[x == y for y in mine] for x in mine] == [[x == y for y in want] for x in want]


def test_recall_of_bands_and_radius():
    rng = random.Random(44)
    met = total = 0
    for _ in range(600):
        base = " ".join(rng.choice(WORDS) for _ in range(rng.choice([60, 300])))
        other = edited(rng, base, len(base.split()) // 40)
        a, b = (similar.shingle_set(t.encode()) for t in (base, other))
        both = len(np.intersect1d(a, b))
        if 0.8 * (len(a) + len(b) - both) <= both < 0.9 * (len(a) + len(b) - both):
            x, y = similar.majority(np.concatenate((a, b)), np.array([len(a), len(b)]))
            met += bool(set(similar.bands(a).tolist()) & set(similar.bands(b).tolist())) and int(x ^ y).bit_count() <= similar.RADIUS
            total += 1
    assert total > 100 and met >= 0.98 * total


def test_shingles_are_those_of_the_plain_rule():
    for t in ("A b C d e F", "x", "", None, "ä Ä a\tb\nc\x0bd  e f"):
        assert sorted(similar.shingle_set(t and t.encode())) == sorted(xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t))
