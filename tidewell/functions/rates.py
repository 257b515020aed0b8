"""Scheduling formulas as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed values of the schedules.
ALPHA = 0.3
LEAST_INTERVAL_S, MOST_INTERVAL_S, CAPACITY, BUFFER = 60.0, 21600.0, 100.0, 2.0
MULTIPLIER, PAGE, LEAST_A_DAY, MOST_A_DAY = 4.0, 250.0, 4.0, 500.0


def instant_rate(count: Column, span_s: Column) -> Column:
    """Items a second over the batch's publication span; 0 where the span is."""
    return F.when(span_s > 0, count / span_s).otherwise(0.0)


def ewma(rates: Column, alpha: float = ALPHA) -> Column:
    """Fold of ordered rates: the first is taken as it is (again after a rate of 0), later ones are averaged in."""
    return F.aggregate(rates, F.lit(0.0), lambda r, x: F.when(r == 0.0, x).otherwise(alpha * x + (1 - alpha) * r))


def latest_ewma(rows: DataFrame, key: str, order: str, rate: str, alpha: float = ALPHA) -> DataFrame:
    """``(key, rate)``: the fold of ``ewma`` over each key's rates (0 or more) in ``order``, without gathering them.

    The fold is a weighted sum: the n-th latest rate counts ``alpha (1 - alpha)^n``, the first above 0 its whole rest,
    and those before it nothing. Rows are ranked within their key by a sort that may spill, and summed in parts.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())) - 1
    first = F.min(F.when(F.col(rate) != 0, F.col(order))).over(Window.partitionBy(key))
    ranked = rows.select(key, order, rate, back.alias("_back"), first.alias("_first"))
    weight = F.when(F.col(order) == F.col("_first"), 1.0).when(F.col(order) > F.col("_first"), alpha).otherwise(0.0) * F.pow(F.lit(1 - alpha), F.col("_back"))
    return ranked.groupBy(key).agg(F.coalesce(F.sum(F.col(rate) * weight), F.lit(0.0)).alias("rate"))


def revisit_seconds(rate: Column, new_items: Column) -> Column:
    """Time until the next visit: a full page's worth at the buffered rate, within bounds; the longest if nothing is new."""
    wait = F.least(F.lit(MOST_INTERVAL_S), F.greatest(F.lit(LEAST_INTERVAL_S), CAPACITY / (rate * BUFFER)))
    return F.when((new_items > 0) & (rate > 0), wait).otherwise(MOST_INTERVAL_S)


def scrapes_a_day(new_items: Column, elapsed_s: Column) -> Column:
    """Visits a day that keep up with what arrived over ``elapsed_s`` (at least a second), within bounds."""
    raw = MULTIPLIER * (new_items / F.greatest(elapsed_s, F.lit(1.0)) * 86400.0) / PAGE
    return F.when(new_items <= 0, F.lit(LEAST_A_DAY)).otherwise(F.greatest(F.lit(LEAST_A_DAY), F.least(F.lit(MOST_A_DAY), raw)))


def percent_complete(oldest: Column, start: Column, end: Column) -> Column:
    """How much of ``start .. end`` a backward crawl to ``oldest`` covers, 0 to 100; null counts as nothing."""
    sec = lambda c: F.unix_micros(c.cast("timestamp"))
    share = (sec(end) - sec(oldest)) / (sec(end) - sec(start))
    return 100.0 * F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(0.0))
