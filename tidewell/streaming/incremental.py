"""Incremental runs as streams: each new file of posts is labelled and matched once, whatever restarts happen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions import rates
from tidewell.operators import matching


def match_stream(spark: SparkSession, source: str, schema: str, terms: DataFrame, out: str, checkpoint: str, version: str = "v1"):
    """Span hits of every file that arrives in ``source``, appended to ``out`` with the batch as its partition.

    A batch that runs again after a failure overwrites its own partition only, so hits are written once.
    """
    posts = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        hits = matching.span_hits(batch.dropDuplicates(["post_id"]), terms).withColumns({"matcher_version": F.lit(version), "batch": F.lit(number)})
        hits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_stream(spark: SparkSession, source: str, schema: str, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Labels of new posts by an injected ``label`` (DataFrame to DataFrame), appended to ``out``."""
    return label(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_new(posts: DataFrame, cursor: int, label: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """``(labels, new cursor)`` of the posts after ``cursor``, by ascending id; the cursor moves to the largest id there is."""
    top = posts.agg(F.max("post_id")).first()[0]
    return label(posts.filter(F.col("post_id") > cursor)), max(cursor, top if top is not None else cursor)


def recheck(posts: DataFrame, cursor: int, label: Callable[[DataFrame], DataFrame], platform: str | None = None) -> DataFrame:
    """Labels of posts below ``cursor`` that still have none, of one platform or of all."""
    old = posts.filter((F.col("post_id") < cursor) & F.col("is_en").isNull())
    return label(old if platform is None else old.filter(F.col("platform") == platform))


def first_seen(events: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Streaming insert-if-absent: the first event of each key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, ts: str, by: str, delay: str = "1 day") -> DataFrame:
    """Tumbling days per ``by``; events later than ``delay`` are dropped."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def rate_stream(batches: DataFrame, key: str, count: str, span: str, order: str) -> DataFrame:
    """Running exponentially weighted rate per key, with the rate so far as state; ``(key, rate)`` per update.

    Rows of an update are taken in ``order``.
    """
    import pandas as pd

    def update(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rate = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(order)
        for n, s in zip(rows[count], rows[span]):
            now = n / s if s > 0 else 0.0
            rate = now if rate == 0.0 else rates.ALPHA * now + (1 - rates.ALPHA) * rate
        state.update((rate,))
        yield pd.DataFrame({key: [name[0]], "rate": [rate]})

    kind = batches.schema[key].dataType.simpleString()
    return batches.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, rate double", "rate double", "update", "NoTimeout")
