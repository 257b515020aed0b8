"""State machines of the collectors: budgets, slots, backward windows, early stops and leases."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.session import materialise, ship

LEASE_HOURS, MOST_SECONDS = 6, 10800


def leasable(as_of: str, most_seconds: int | None = None) -> Column:
    """Items without a transcript that nobody works on: never started, or started longer ago than a lease lasts."""
    free = F.col("transcript").isNull() & (F.col("transcription_started_at").isNull() | (F.col("transcription_started_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(LEASE_HOURS))))
    return free if most_seconds is None else free & F.col("duration_seconds").isNotNull() & (F.col("duration_seconds") <= most_seconds)


def next_items(rows: DataFrame, as_of: str, n: int = 1, most_seconds: int | None = None) -> DataFrame:
    """The oldest leasable items, unknown ages last, ties by id."""
    return rows.filter(leasable(as_of, most_seconds)).orderBy(F.asc_nulls_last("created_at_ts"), F.asc("id")).limit(n)


def charge(events: DataFrame, budget: int, day: str = "day", order: str = "seq", units: str = "units") -> DataFrame:
    """Each day's requests in order; one that would pass the budget is rejected and does not count.

    A running sum would count what was rejected. Requests are dealt by ranges of day and order, so that a day may be many
    parts. Of each part and day a table is made first that says, for every number of units that may be used at its
    beginning, how many are at its end; a day's tables in their order then give each part its beginning, and its requests
    are charged from there. Requests without units, or of fewer than none, are rejected. Result: day, seq, units, accepted,
    used (after the request).
    """
    spark = events.sparkSession
    ship(spark)
    rows = events.select(F.col(day).alias("day"), F.col(order).cast("long").alias("seq"), F.col(units).cast("long").alias("units"))
    kind = rows.schema["day"].dataType.simpleString()
    dealt = materialise(rows.repartitionByRange("day", "seq", "units").withColumn("part", F.spark_partition_id()), "requests")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, day), asked in _runs(batches):
            used = np.arange(budget + 1)
            for batch in asked:
                for u in batch:
                    if u is not None and 0 <= u <= budget:
                        used[used + u <= budget] += u
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), day, pa.array([used.tolist()], pa.list_(pa.int64()))], ["part", "day", "ends"])

    def begin(table: pa.Table) -> pa.Table:
        table, used, out = table.sort_by("part"), 0, []
        for ends in table.column("ends"):
            out.append(used)
            used = ends[used].as_py()
        return table.select(["part", "day"]).append_column("begin", pa.array(out, pa.int64()))

    def charged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for batch in batches:
            accepted, after = [], []
            for part, d, u, first in zip(*(batch.column(k).to_pylist() for k in (4, 0, 2, 3))):
                if (part, d) != now:
                    now, used = (part, d), first
                ok = u is not None and u >= 0 and used + u <= budget
                used += u if ok else 0
                accepted.append(ok)
                after.append(used)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], ["day", "seq", "units", "accepted", "used"])

    in_order = lambda some: some.repartition("part").sortWithinPartitions("part", "day", "seq", "units")
    ends = in_order(dealt).select("part", "day", "units").mapInArrow(tables, f"part int, day {kind}, ends array<long>")
    begins = materialise(ends.groupBy("day").applyInArrow(begin, f"part int, day {kind}, begin long"), "begins")
    placed = dealt.alias("r").join(begins.alias("b"), (F.col("r.part") == F.col("b.part")) & F.col("r.day").eqNullSafe(F.col("b.day")))
    own = in_order(placed.select("r.day", "r.seq", "r.units", "b.begin", "r.part"))
    return own.mapInArrow(charged, f"day {kind}, seq long, units long, accepted boolean, used long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, pa.Array], Iterator[list]]]:
    """``((part, day), lists of units)`` of each run of rows with the same part and day; a run is passed on batch by batch."""

    def pieces() -> Iterator[tuple[tuple, pa.Array, list]]:
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            at = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[at]:
                    yield keys[at], batch.column(1).slice(at, 1), batch.column(2).slice(at, k - at).to_pylist()
                    at = k

    for key, run in groupby(pieces(), lambda x: x[0]):
        first = next(run)
        yield (key[0], first[1]), (x[2] for x in chain([first], run))


def backoff_seconds(attempt: Column, retry_after: Column, draw: Column, first: float = 2.0, most: float = 300.0) -> Column:
    """Seconds to wait after failed attempt 0, 1, ...: what the server asks for (a second at least) or a doubling delay,
    at most ``most``, times 0.8 to 1.2 by ``draw`` (0 to 1)."""
    asked = F.greatest(retry_after.cast("double"), F.lit(1.0))
    delay = F.least(F.lit(first) * F.pow(F.lit(2.0), attempt.cast("double")), F.lit(most))
    return F.least(F.when(retry_after.isNotNull(), asked).otherwise(delay), F.lit(most)) * (0.8 + 0.4 * draw)


def due_runs(queue: DataFrame, state: DataFrame, as_of: str, key: str = "term_id", at: str = "next_run_at") -> DataFrame:
    """Queue entries ``(key, at)`` to run now, earliest first, ties by key.

    An entry is stale, and left out, unless it is what the state holds for its key: queues get a new entry whenever a key is
    scheduled again and keep the old ones.
    """
    return queue.join(state.select(key, at), [key, at], "left_semi").distinct().filter(F.col(at) <= F.lit(as_of).cast("timestamp")).orderBy(at, key)


def slots(start: Column, seconds: Column, n: int = 20, spread: float = 0.9, draw: Column | None = None) -> Column:
    """One slot in each of ``n`` equal buckets over the first ``spread`` of a session; ``draw`` is the place in a bucket (0 to 1)."""
    width = seconds * spread / n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + width * (i + (F.lit(0.5) if draw is None else draw)))


def stopping_page(pages: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """The first page without new items, or with too small a share of them; null if none."""
    stop = (F.col("new") == 0) | (F.col("new") / F.greatest(F.col("found"), F.lit(1)) < threshold)
    return pages.groupBy(*by).agg(F.min(F.when(stop, F.col("page"))).alias("stop_page"))


@dataclass(frozen=True)
class Backfill:
    """Plan of a backward crawl: the window to visit next and its length."""

    end: datetime
    days: float = 30.0

    LEAST, MOST, OVERLAP = 7.0, 90.0, timedelta(minutes=5)

    @property
    def window(self) -> tuple[datetime, datetime]:
        return self.end - timedelta(days=self.days), self.end

    def after(self, saturated: bool) -> Backfill:
        """A saturated window is tried again at half the length while that is allowed; a clean one lets the next,
        which overlaps it a little, be twice as long."""
        if saturated and self.days > self.LEAST:
            return replace(self, days=max(self.LEAST, self.days / 2))
        start = self.window[0]
        return Backfill(start + self.OVERLAP, self.days if saturated else min(self.MOST, self.days * 2))


#: Reasons and statuses of HTTP answers by what they call for: fixed values.
QUOTA = ("quotaExceeded", "dailyLimitExceeded", "dailyLimitExceededUnreg")
TRANSIENT = (429, 500, 502, 503, 504)
THROTTLED = ("userRateLimitExceeded", "rateLimitExceeded", "servingLimitExceeded", "concurrentLimitExceeded", "limitExceeded")


def error_kind(status: Column, reason: Column) -> Column:
    """What to do about an HTTP error: quota (wait for the next day), retryable (an error without an answer too) or fatal."""
    known = F.coalesce(reason, F.lit(""))
    again = status.isNull() | status.isin(*TRANSIENT) | ((status == 403) & known.isin(*THROTTLED))
    return F.when(known.isin(*QUOTA), "quota").when(again, "retryable").otherwise("fatal")


def error_reason(body: Column) -> Column:
    """The first reason in an error answer's JSON; null if it has none."""
    errors = F.from_json(body, "error struct<errors: array<struct<reason: string>>>")["error"]["errors"]
    return F.get(F.filter(errors["reason"], lambda r: F.coalesce(r, F.lit("")) != ""), F.lit(0))
