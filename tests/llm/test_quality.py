"""Groups and distances of the quality method on made documents."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng, vocabulary, n, mark=""):
    return [" ".join(rng.choice(vocabulary) + mark for _ in range(rng.randint(80, 300))) for _ in range(n)]


def words(rng):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2000)]


def test_small_sources_are_judged(spark):
    rng = random.Random(5)
    vocabulary = words(rng)
    rows = [(t, "en", "large") for t in prose(rng, vocabulary, 120)] + [(t, "en", "small") for t in prose(rng, vocabulary, 20)]
    rows += [(t, "de", "other") for t in prose(rng, vocabulary, 20)] + [(t, "en", "small") for t in prose(rng, vocabulary, 2, "$$$%")] + [(t, None, None) for t in prose(rng, vocabulary, 2, "$$$%")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], SCHEMA)
    keys = {(r["lang"], r["source"]): r["grp"] for r in quality.grouped(docs).collect()}
    assert keys == {("en", "large"): "=en\t=large", ("en", "small"): "=en", ("de", "other"): "*", (None, None): "*"}
    sizes = {r["grp"]: r["count"] for r in quality.placed(docs, quality.grouped(docs)).groupBy("grp").count().collect()}
    assert sizes == {"=en\t=large": 120, "=en": 142, "*": 164}
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(r["d2"] is not None for r in got.values()) and len(got) == 164
    assert all(got[k]["kept"] for k in range(160)) and not any(got[k]["kept"] for k in range(160, 164))


def test_floors_are_a_minimum_and_the_cutoff_a_quantile(spark):
    rng = random.Random(6)
    rows = [("g", *(rng.gauss(0, 3 if k < 2 else 0) for k in range(5))) for _ in range(500)]
    est = quality._estimate(spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")).first()
    mean = sum(r[1] for r in rows) / 500
    var = quality.CONSISTENCY * sum((r[1] - mean) ** 2 for r in rows) / 500
    assert abs(est["w00"] * var**0.5 - 1) < 1e-6 and abs(est["w22"] * quality.STATISTICS["x2"] - 1) < 1e-6
    x = quality.CUTOFF
    beyond = math.erfc((x / 2) ** 0.5) + (2 * x / math.pi) ** 0.5 * math.exp(-x / 2) * (1 + x / 3)
    assert abs(beyond - 0.001) < 1e-5


def plain_estimate(x):
    floors = np.array(list(quality.STATISTICS.values()))
    cov = (np.einsum("ni,nj->ij", x, x) / len(x) - np.outer(x.mean(0), x.mean(0))) * quality.CONSISTENCY
    cov[np.diag_indices(5)] = np.maximum(np.diag(cov), floors**2)
    return x.mean(0), cov


def plain_steps(x, mean, cov):
    """Concentration steps with exact supports until the determinant falls no further."""
    h, best, before = math.ceil(quality.SUPPORT * len(x)), None, math.inf
    for _ in range(60):
        d = x - mean
        d2 = np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)
        mean, cov = plain_estimate(x[np.argsort(d2, kind="stable")[:h]])
        log_det = np.linalg.slogdet(cov)[1]
        if best is None or log_det < best[0]:
            best = log_det, mean, cov
        if log_det > before - quality.SETTLED:
            break
        before = log_det
    return best


def test_smallest_determinant_of_several_starts(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g, (n, far) in enumerate([(400, 0.0), (300, 0.2), (500, 0.42)]):  # a part of some groups lies apart
        x = rng.normal(size=(n, 5)) @ np.diag([1.0, 0.5, 0.3, 0.4, 0.3]) + 4
        k = int(far * n)
        x[:k] += [6, 3, 2, 0, 0]
        groups[f"g{g}"] = x
    rows = [(int(1000 * int(g[1]) + i), g, *map(float, r)) for g, x in groups.items() for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "doc_id long, grp string, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(4)
    estimate = quality.estimate(table)
    got = {r["grp"]: r for r in estimate.collect()}
    starts = {(r["grp"], r["start"]): r for r in quality._starts(table).collect()}
    for g, x in groups.items():
        found = []
        for k in range(2 + quality.PARTS):
            r = starts[g, k]
            w = np.array([[r[f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
            found.append(plain_steps(x, np.array([r[f"u{i}"] for i in range(5)]), np.linalg.inv(w.T @ w)))
        best = min(found, key=lambda f: f[0])
        assert abs(got[g]["log_det"] - best[0]) < 0.02, (g, got[g]["log_det"], [f[0] for f in found])
        w = np.array([[got[g][f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        assert np.allclose(np.linalg.inv(w.T @ w), best[2], rtol=0.05, atol=0.02) and np.allclose([got[g][f"u{i}"] for i in range(5)], best[1], atol=0.05)
    beyond = quality.with_distance(table.filter("grp = 'g1'"), estimate).withColumn("apart", F.col("doc_id") < 1060)
    shares = {r["apart"]: r["s"] for r in beyond.groupBy("apart").agg(F.avg((F.col("d2") > quality.CUTOFF).cast("int")).alias("s")).collect()}
    assert shares[True] > 0.99 and shares[False] < 0.03


def test_repeated_windows_of_long_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (3, 4, 5, 700)] + [" ".join(str(rng.randrange(3000)) for _ in range(60_000)), "a b c a b c", "x y z", "a a a a"]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.counts(docs).collect()}
    for k, t in enumerate(texts):
        w, seen = t.split(), {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        assert got[k] == len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})
