"""Time functions as native column expressions; times are UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PACIFIC = "America/Los_Angeles"


def day(ts: Column) -> Column:
    return F.to_date(ts)


def trailing(ts: Column, as_of: str, days: int = 0, hours: int = 0) -> Column:
    """Whether ``ts`` is no earlier than so long before ``as_of``."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days), F.lit(hours))
    return ts >= since


def parse_iso(raw: Column) -> Column:
    """UTC time of an ISO string; null for blank or malformed ones."""
    return F.try_to_timestamp(F.nullif(F.trim(raw), F.lit("")))


def duration_seconds(iso: Column) -> Column:
    """Seconds of an ISO-8601 duration in weeks, days, hours, minutes and seconds; null if malformed."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(iso, unit, 1), F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(0))
    total = part(r"^P(?:.*?)(\d+)W") * 604800 + part(r"^P(?:[^T]*?)(\d+)D") * 86400 + part(r"T(?:.*?)(\d+)H") * 3600 + part(r"T(?:.*?)(\d+)M") * 60 + part(r"T(?:.*?)(\d+)(?:\.\d+)?S")
    return F.when(iso.rlike(r"^P(?=.)(?:\d+W)?(?:\d+D)?(?:T(?=.)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"), total)


def pacific_day(ts: Column) -> Column:
    """Calendar day in Pacific time, on which daily budgets turn over."""
    return F.to_date(F.from_utc_timestamp(ts, PACIFIC))


def next_pacific_midnight(ts: Column) -> Column:
    return F.to_utc_timestamp(F.date_add(pacific_day(ts), 1).cast("timestamp"), PACIFIC)


def next_session(ts: Column, hours: tuple[int, ...] = (9, 18), length_hours: int = 3) -> Column:
    """``{start, end}`` (UTC) of the Pacific-time session that holds ``ts``, or else of the next one to begin."""
    candidates = F.array(
        *(
            F.struct(
                F.to_utc_timestamp(F.date_add(pacific_day(ts), d).cast("timestamp") + F.make_dt_interval(hours=F.lit(h)), PACIFIC).alias("start"),
                F.to_utc_timestamp(F.date_add(pacific_day(ts), d).cast("timestamp") + F.make_dt_interval(hours=F.lit(h + length_hours)), PACIFIC).alias("end"),
            )
            for d in (0, 1)
            for h in hours
        )
    )
    return F.array_min(F.filter(candidates, lambda w: w["end"] > ts))
