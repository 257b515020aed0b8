"""Leases as a stream: expiry by timer, late completion, restarts."""

from datetime import datetime, timedelta

import pytest

from tidewell.session import scratch
from tidewell.streaming import leases

START = datetime(2024, 1, 1)
SCHEMA = "item_id string, kind string, worker string, at timestamp"


@pytest.fixture()
def stream(spark):
    before = spark.conf.get(leases._PROVIDER)
    leases.keep_timers(spark)
    source, out, checkpoint = (scratch(spark, x) for x in ("events", "out", "checkpoint"))

    def run(rows):
        """Outcomes so far after a run, which starts anew, over one more file of events."""
        spark.createDataFrame([(i, k, w, START + timedelta(hours=h)) for i, k, w, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        query = leases.lease_stream(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        found = spark.read.schema(leases._OUT).parquet(out).collect()
        return {i: [(r["outcome"], r["worker"], (r["at"] - START) / timedelta(hours=1)) for r in sorted(found, key=lambda r: (r["at"], r["outcome"] != "expired")) if r["item_id"] == i] for i in {r["item_id"] for r in found}}

    yield run
    spark.conf.set(leases._PROVIDER, before)


def test_leases_expire_by_timer_and_late_work_counts(stream):
    got = stream([("a", "offered", None, 0), ("b", "offered", None, 0), ("c", "offered", None, 0), ("a", "claimed", "w1", 1), ("b", "claimed", "w1", 1), ("a", "claimed", "w2", 2), ("x", "claimed", "w2", 2)])
    assert got["a"] == [("available", None, 0), ("leased", "w1", 1), ("refused", "w2", 2)] and got["x"] == [("refused", "w2", 2)]
    got = stream([("b", "completed", "w1", 6)])
    assert got["b"][-1] == ("completed", "w1", 6)
    # only c has an event: the watermark passes the lease of a, whose timer ends it
    got = stream([("c", "claimed", "w3", 8)])
    got = stream([("c", "released", "w3", 9)])
    assert got["a"][-1] == ("expired", "w1", 7) and got["c"][-2:] == [("leased", "w3", 8), ("available", "w3", 9)]
    assert got["b"][-1] == ("completed", "w1", 6)
    got = stream([("a", "claimed", "w2", 9.5), ("a", "completed", "w1", 10), ("a", "completed", "w2", 11), ("b", "claimed", "w4", 11)])
    assert got["a"][-3:] == [("leased", "w2", 9.5), ("completed late", "w1", 10), ("refused", "w2", 11)]
    assert got["b"][-1] == ("refused", "w4", 11)
    got = stream([("c", "offered", None, 40)])
    got = stream([("c", "offered", None, 41)])
    assert [x[0] for x in got["a"]].count("expired") == 1 and [x[0] for x in got["c"]].count("available") == 2


def test_outcomes_do_not_depend_on_batches(stream):
    # a claim that finds a lease over before its timer did
    got = stream([("a", "offered", None, 0), ("a", "claimed", "w1", 0), ("a", "claimed", "w2", 6), ("a", "claimed", "w3", 6.5), ("a", "completed", "w1", 7), ("a", "offered", None, 8)])
    assert got["a"] == [("available", None, 0), ("leased", "w1", 0), ("expired", "w1", 6), ("refused", "w2", 6), ("leased", "w3", 6.5), ("completed late", "w1", 7)]
