"""A leased work queue as a stream: items are offered, claimed, completed or released, and timers end what lasts too long.

Each item is a key of state with at most one lease, which ends ``LEASE`` after its claim: by an event-time timer when
the watermark passes it, or at once when the item's next event is later than that. Which of the two comes first
depends on the batches; what comes out does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.operators.schedule import LEASE_HOURS
from tidewell.session import ship

LEASE = timedelta(hours=LEASE_HOURS)
#: What an event asks for.
OFFERED, CLAIMED, COMPLETED, RELEASED = "offered", "claimed", "completed", "released"

_STATE = "status string, worker string, until timestamp"
_OUT = "item_id string, outcome string, worker string, at timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = {OFFERED: 0, COMPLETED: 1, RELEASED: 2, CLAIMED: 3}


def _millis(at: pd.Timestamp) -> int:
    """The first whole millisecond at or behind ``at``."""
    return -(-at.value // 1_000_000)


class _Queue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.item = handle, handle.getValueState("item", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.assign(_order=events["kind"].map(_ORDER)).sort_values(["at", "_order", "worker"], kind="stable")
        status, worker, until = self._read()
        armed, out = until, []
        for kind, who, at in zip(events["kind"], events["worker"], events["at"]):
            if status == "leased" and at > until:
                out.append(("expired", worker, until))
                status, worker, until = "available", None, None
            if kind == OFFERED and status is None:
                status = "available"
                out.append(("available", None, at))
            elif kind == CLAIMED:
                if status == "available":
                    status, worker, until = "leased", who, at + LEASE
                    out.append(("leased", who, at))
                else:
                    out.append(("refused", who, at))
            elif kind == COMPLETED and status is not None:
                if status == "completed":
                    out.append(("refused", who, at))
                else:  # work that is done counts, even after its lease
                    out.append(("completed" if status == "leased" and who == worker else "completed late", who, at))
                    status, worker, until = "completed", who, None
            elif kind == RELEASED and status == "leased" and who == worker:
                status, worker, until = "available", None, None
                out.append(("available", who, at))
        if armed is not None and armed != until:
            self.handle.deleteTimer(_millis(armed))
        if until is not None and armed != until:
            self.handle.registerTimer(_millis(until))
        self._write(status, worker, until)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, worker, until = self._read()
        if status == "leased" and _millis(until) <= expiredTimerInfo.getExpiryTimeInMs():
            self._write("available", None, None)
            yield self._rows(key, [("expired", worker, until)])
        else:
            yield self._rows(key, [])

    def close(self) -> None:
        pass

    def _read(self) -> tuple[str | None, str | None, pd.Timestamp | None]:
        own = self.item.get() if self.item.exists() else None
        return (own[0], own[1], None if own[2] is None else pd.Timestamp(own[2]).tz_localize(None)) if own else (None, None, None)

    def _write(self, status: str | None, worker: str | None, until: pd.Timestamp | None) -> None:
        if status is not None:
            self.item.update((status, worker, None if until is None else until.to_pydatetime()))

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*out)) or [(), (), ()]
        text = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({"item_id": text([key[0]] * len(out)), "outcome": text(columns[0]), "worker": text(columns[1]), "at": pd.Series(columns[2], dtype="datetime64[ns]")})


def lease_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``(item_id, outcome, worker, at)`` of a stream of ``(item_id, kind, worker, at)``.

    Outcomes: ``available`` (offered first, or released by who holds it), ``leased``, ``refused`` (a claim of an item that is
    leased, completed or unknown, or a second completion), ``expired`` (six hours after the claim, strictly later claims
    included), ``completed``, and ``completed late`` where the lease was over or another's. Events may be late by ``delay``.
    The session must keep state in RocksDB, which ``keep_timers`` sets.
    """
    ship(events.sparkSession)
    rows = events.select("item_id", "kind", "worker", "at").withWatermark("at", delay)
    return rows.groupBy("item_id").transformWithStateInPandas(statefulProcessor=_Queue(), outputStructType=_OUT, outputMode="append", timeMode="EventTime")


def keep_timers(spark: SparkSession) -> None:
    """Let streams that are started from now on keep state in RocksDB, which timers need."""
    spark.conf.set(_PROVIDER, _ROCKS)
