"""Keyset cursors: order, pages and restarts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.session import scratch
from tidewell.sources import cursors

START = datetime(2024, 1, 1)


def local(path):
    return path.removeprefix("file://")


@pytest.fixture(scope="module")
def registered(spark):
    cursors.register(spark)
    name = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(name)
    spark.conf.set(name, "TIMESTAMP_MICROS")  # which has statistics
    yield spark
    spark.conf.set(name, before)


def write(spark, rows, path, parts=3):
    spark.createDataFrame(rows, "id long, ts timestamp, text string").repartition(parts).write.mode("append").option("parquet.block.size", 512).parquet(path)


def made(ids, rng):
    # few different times, so that the id has to part them
    return [(k, START + timedelta(minutes=rng.randint(0, 5) + k // 100), f"t{k}") for k in ids]


def test_batch_is_in_the_order_of_the_key(registered):
    spark, rng, path = registered, random.Random(1), scratch(registered, "keyset")
    rows = made(range(400), rng)
    for part in (rows[:150], rows[300:], rows[150:300]):
        write(spark, part, path)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    for options in ({}, {"rows": 40, "page": 7}):
        df = spark.read.format("keyset").options(path=path, order="ts,id", **options).load()
        got = df.collect()
        assert [r["id"] for r in got] == want and df.columns == ["id", "ts", "text"]
    assert df.select(F.spark_partition_id()).distinct().count() > 2
    key = sorted((r[1], r[0]) for r in rows)[120]
    after = json.dumps([cursors._plain(key[0]), key[1]])
    got = spark.read.format("keyset").options(path=path, order="ts,id", after=after, rows=50).load()
    assert [r["id"] for r in got.collect()] == want[121:]
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    old = scratch(spark, "keyset")
    write(spark, rows, old)
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    got = spark.read.format("keyset").options(path=old, order="ts,id", after=after).load()
    assert [r["id"] for r in got.collect()] == want[121:] and got.select("ts").distinct().count() > 1
    by_id = spark.read.format("keyset").options(path=path, order="id", after="[250]", rows=30).load()
    assert [r["id"] for r in by_id.collect()] == list(range(251, 400))


def test_stream_restarts_without_repeats_or_gaps(registered):
    spark, rng, path = registered, random.Random(2), scratch(registered, "keyset")
    out, checkpoint = scratch(spark, "out"), scratch(spark, "checkpoint")

    def run():
        source = spark.readStream.format("keyset").options(path=path, order="ts,id", rows=60, page=11).load()
        source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    seen = []
    for k in range(4):
        # each run's first rows share the time of the last run's last one and have larger ids
        top = START + timedelta(days=k)
        ids = range(k * 100, k * 100 + 100)
        rows = [(i, top + timedelta(minutes=rng.randint(0, 3)), f"t{i}") for i in ids]
        rows[-1] = (rows[-1][0], top + timedelta(days=1), "last")
        write(spark, rows, path)
        seen += list(ids)
        assert run() == seen
    assert run() == seen


def test_stream_goes_on_after_a_failure(registered):
    spark, rng, path = registered, random.Random(3), scratch(registered, "keyset")
    checkpoint, got = scratch(spark, "checkpoint"), []
    write(spark, made(range(100), rng), path)

    def run(fail):
        def sink(batch, number):
            own = [r["id"] for r in batch.collect()]
            if fail:
                raise ValueError("lost")
            got.extend(own)

        source = spark.readStream.format("keyset").options(path=path, order="ts,id").load()
        query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            assert fail

    run(fail=True)
    assert not got
    write(spark, made(range(1000, 1100), rng), path)
    run(fail=False)
    run(fail=False)
    assert sorted(got) == [*range(100), *range(1000, 1100)]


def test_stream_from_the_latest_row(registered):
    spark, path, out, checkpoint = registered, *(scratch(registered, x) for x in ("keyset", "out", "checkpoint"))
    write(spark, [(k, START, "old") for k in range(10)], path)

    def run():
        source = spark.readStream.format("keyset").options(path=path, order="ts,id", **{"from": "latest"}).load()
        source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    write(spark, [(k, START, "new") for k in range(10, 15)], path)
    run()
    assert sorted(r["id"] for r in spark.read.schema("id long, ts timestamp, text string").parquet(out).collect()) == list(range(10, 15))
