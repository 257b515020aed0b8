"""A registry that follows its sources: equal to the full comparison, reading only what differs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import sync
from tidewell.session import scratch

SCHEMA = "platform string, key1 string, key2 string"


def keys_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bits,part_bits", [(6, 3), (1, 1), (10, 4)])
def test_inserts_and_deletes_equal_the_full_comparison(spark, bits, part_bits):
    rng = random.Random(bits)
    kept = sync.Kept(spark, scratch(spark, "registry"), bits, part_bits)
    ids, top, now = {}, 0, set()
    for _ in range(4):
        now = {k for k in now if rng.random() > 0.1} | {(rng.choice(["tweet", "news"]), str(rng.randint(0, 400)), rng.choice(["", "1"])) for _ in range(60)}
        rows = [*now, *list(now)[:20], (None, "1", ""), ("tweet", None, ""), ("tweet", "1", None)]
        rng.shuffle(rows)
        inserted, deleted = kept.sync(keys_of(spark, rows))
        new, gone = now - ids.keys(), ids.keys() - now
        assert {tuple(r)[1:]: r["id"] for r in deleted.collect()} == {k: ids[k] for k in gone}
        for k in gone:
            del ids[k]
        for n, k in enumerate(sorted(new), top + 1):
            ids[k] = n
        top += len(new)
        assert {tuple(r)[1:]: r["id"] for r in inserted.collect()} == {k: ids[k] for k in new}
        assert {(r["platform"], r["key1"], r["key2"]): r["id"] for r in kept.rows().collect()} == ids and kept.top() == top
    assert [x.count() for x in kept.sync(keys_of(spark, list(now)))] == [0, 0]
    assert [x.count() for x in kept.sync(keys_of(spark, []))] == [0, len(ids)] and kept.rows().count() == 0
    back, _ = kept.sync(keys_of(spark, [("tweet", "1", "")]))
    assert [r["id"] for r in back.collect()] == [top + 1]


def test_only_differing_leaves_are_named(spark):
    rows = keys_of(spark, [("tweet", str(k), "") for k in range(3000)]).withColumn("leaf", sync.leaf_of(8))
    other = rows.filter("key1 <> '77'").unionByName(keys_of(spark, [("news", "5", "")]).withColumn("leaf", sync.leaf_of(8)))
    odd = {r["leaf"] for r in rows.filter("key1 = '77'").unionByName(other.filter("platform = 'news'")).collect()}
    assert set(sync.differing(sync.leaves(rows), sync.leaves(other), 8)) == odd
    assert sync.differing(sync.leaves(rows), sync.leaves(rows), 8) == []
    # keys that trade places between leaves of the same size are seen by the digest
    a, b = (keys_of(spark, [("tweet", k, "")]).withColumn("leaf", F.lit(3)) for k in ("1", "2"))
    assert sync.differing(sync.leaves(a), sync.leaves(b), 8) == [3]


def test_unchanged_parts_are_not_rewritten(spark):
    path = scratch(spark, "registry")
    kept = sync.Kept(spark, path, 8, 4)
    rows = [("tweet", str(k), "") for k in range(500)]
    kept.sync(keys_of(spark, rows))
    files = lambda: {r[0] for r in spark.read.parquet(f"{path}/rows").select(F.input_file_name()).distinct().collect()}
    before = files()
    kept.sync(keys_of(spark, [*rows, ("tweet", "new", "")]))
    assert len(before) == 16 and len(before & files()) == 15
