"""Reports: counts by day and platform, coverage, pivots, forecasts and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions import arrays


def daily(rows: DataFrame, ts: str, by: list[str] | None = None, n: str = "n") -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day"), *(by or [])).agg(F.count("*").alias(n))


def tri_state(flag: str, prefix: str) -> list[Column]:
    """Counts of true, false and unknown."""
    return [F.count_if(F.col(flag).eqNullSafe(F.lit(True))).alias(f"{prefix}_true"), F.count_if(F.col(flag).eqNullSafe(F.lit(False))).alias(f"{prefix}_false"), F.count_if(F.col(flag).isNull()).alias(f"{prefix}_null")]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two places, half up in decimal; null where there is nothing to share."""
    return F.when(whole > 0, F.round(F.lit(100).cast("decimal(20,0)") * part.cast("decimal(20,0)") / whole.cast("decimal(20,0)"), 2).cast("double"))


def round_binary(x: Column) -> Column:
    """``x`` (0 or more) rounded to two places by its exact binary value, ties to the even digit.

    The nearest tie is an odd number of two-hundredths. Splitting ``x`` at 26 bits makes both products with 200 exact, so
    the sign of their difference to that number says on which side ``x`` lies.
    """

    def of(v: Column) -> Column:
        low = F.floor(v * 100)
        big = v * 134217729.0
        high = big - (big - v)
        side = (high * 200 - (2 * low + 1)) + (v - high) * 200
        return (low + F.when(side > 0, 1).when((side == 0) & (low % 2 != 0), 1).otherwise(0)) / F.lit(100.0)

    return arrays.let(x, of)


def coverage(part: Column, whole: Column) -> Column:
    """Share in percent as a quotient of doubles times 100, two places; null where there is nothing to share."""
    return F.when(whole > 0, round_binary(part / whole * F.lit(100.0)))


def pivot_days(counts: DataFrame, platforms: list[str], n: str = "n") -> DataFrame:
    """A row for each day and a column for each platform, 0 where there is no count."""
    return counts.groupBy("day").pivot("platform", platforms).agg(F.sum(n)).na.fill(0)


def last_active_days(pivot: DataFrame, platforms: list[str], days: int) -> DataFrame:
    """The latest days whose total is above zero."""
    total = sum((F.col(p) for p in platforms), F.lit(0))
    return pivot.filter(total > 0).orderBy(F.desc("day")).limit(days)


def forecast(summary: DataFrame, per_day: DataFrame, as_of: str, window: int = 30) -> DataFrame:
    """Average a day over the whole window (idle days too) and the day on which the remaining work ends.

    ``summary``: platform, total, completed; ``per_day``: platform, day, n within the window. Without any progress
    there is no finishing day.
    """
    average = per_day.groupBy("platform").agg((F.sum("n") / window).alias("avg_per_day"))
    rows = summary.join(average, "platform", "left").withColumn("avg_per_day", F.coalesce("avg_per_day", F.lit(0.0))).withColumn("remaining", F.col("total") - F.col("completed"))
    days = F.when(F.col("remaining") <= 0, 0).when(F.col("avg_per_day") > 0, F.ceil(F.col("remaining") / F.col("avg_per_day"))).cast("int")
    return rows.withColumn("days_left", days).withColumn("finish_day", F.date_add(F.lit(as_of).cast("date"), F.col("days_left")))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def publication_span(rows: DataFrame, by: list[str], ts: str) -> DataFrame:
    """Seconds between first and last publication (0 with fewer than two), and the last."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.groupBy(*by).agg(F.when(F.count(ts) < 2, 0.0).otherwise((F.max(t) - F.min(t)) / 1e6).alias("span_s"), F.max(ts).alias("newest"), F.count("*").alias("n"))


def transcript_health(parents: DataFrame, segments: DataFrame, key: str, fk: str) -> DataFrame:
    """Counts over parents (transcript, started, updated) and their segments."""
    own = segments.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias("n_segments"))
    rows = parents.join(own, key, "left")
    done, has = F.col("transcript").isNotNull(), F.col("n_segments").isNotNull()
    return rows.agg(
        F.count("*").alias("total"), F.count_if(done).alias("with_transcript"), F.count_if(done & (F.trim("transcript") == "")).alias("blank_transcript"),
        F.count_if(F.col("started").isNotNull() & ~done).alias("in_progress"), F.count_if(done & ~has).alias("transcript_without_segments"),
        F.count_if(has & ~done).alias("segments_without_transcript"), F.count_if(done & F.col("updated").isNull()).alias("transcript_without_time"), F.coalesce(F.sum("n_segments"), F.lit(0)).alias("segments"),
    )


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded digest of their key: the same rows on every run and partitioning."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)
