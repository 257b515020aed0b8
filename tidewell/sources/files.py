"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tidewell.functions import keys, times
from tidewell.session import materialise
from tidewell.sources.storage import Store

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}

TELEGRAM = "channel_id long, message_id long, link string, date string, text string, raw_type string, views long, forwards long, replies long, reactions_total long, is_pinned boolean, has_media boolean"
VIDEO = "video_id string, url string, title string, description string, published_at string, channel_id string, channel_title string, duration string, view_count long, like_count long, comment_count long"
COMMENT = "video_id string, comment_id string, comment_url string, text string, published_at string, like_count long, raw string"
SUBMISSION_CSV = "id string, title string, subreddit string, created_utc string, cgpt_response string, score string, num_comments string"
COMMENT_CSV = "id string, parent_id string, link_id string, body string, permalink string, created_utc string, subreddit_id string, subreddit_type string, total_awards_received string, subreddit string, score string, gilded string, stickied string, is_submitter string, gildings string, all_awardings string, is_en string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def telegram_posts(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, TELEGRAM)
    return rows.withColumn("created_at_ts", times.parse_iso(F.col("date"))).filter(keys.blank_to_null(F.col("text")).isNotNull())


def videos(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, VIDEO)
    return rows.withColumns({"created_at_ts": times.parse_iso(F.col("published_at")), "duration_seconds": times.duration_seconds(F.col("duration"))})


def video_comments(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, COMMENT).withColumn("created_at_ts", times.parse_iso(F.col("published_at")))


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def submissions(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, SUBMISSION_CSV)
    return rows.withColumns({"created_at_ts": F.timestamp_seconds(F.col("created_utc").try_cast("double")), "score": keys.to_int(F.col("score")), "num_comments": keys.to_int(F.col("num_comments"))})


def comments(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, COMMENT_CSV)
    flags = {c: keys.to_bool(F.col(c)) for c in ("stickied", "is_submitter")} | {"is_en": F.when(keys.blank_to_null(F.col("is_en")).isNotNull(), keys.to_bool(F.col("is_en")))}
    numbers = {c: keys.to_int(F.col(c)) for c in ("score", "gilded", "total_awards_received")}
    return rows.withColumns({"created_at_ts": F.timestamp_seconds(F.col("created_utc").try_cast("double")), **flags, **numbers, "gildings": keys.json_or_text(F.col("gildings")), "all_awardings": keys.json_or_text(F.col("all_awardings"))})


def read_posts_json(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a document's top-level array ``posts``; a document without one raises ValueError."""
    doc = spark.read.option("multiLine", True).json(path)
    if "posts" not in doc.columns or not isinstance(doc.schema["posts"].dataType, T.ArrayType):
        raise ValueError("document has no array 'posts'")
    return doc.select(F.explode("posts").alias("p")).select("p.*")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """``(term, scrapes_per_day)``; the header, comment lines and lines without a number are left out."""
    rows = spark.read.schema("term string, rate string").option("comment", "#").csv(path)
    typed = rows.select(F.trim("term").alias("term"), F.trim("rate").try_cast("double").alias("scrapes_per_day"))
    return typed.filter("term is not null and lower(term) <> 'term' and scrapes_per_day is not null")


def read_terms(spark: SparkSession, path: str, given: list[str] = ()) -> list[str]:
    """Terms given first, then those of a file ('#' begins a comment line), each once in order."""
    lines = [r[0].strip() for r in spark.read.text(path).collect()]
    return list(dict.fromkeys([*(t.strip() for t in given if t.strip()), *(t for t in lines if t and not t.startswith("#"))]))


def rss_entries(rows: DataFrame) -> DataFrame:
    """guid, link and time of feed entries (guid, id, enclosure_href, link, published, updated); blanks are null."""
    b = lambda c: keys.blank_to_null(F.col(c))
    return rows.withColumns({"guid": F.coalesce(b("guid"), b("id")), "download_url": F.coalesce(b("enclosure_href"), b("link")), "created_at_ts": F.coalesce(times.parse_iso(F.col("published")), times.parse_iso(F.col("updated")))})


def api_videos(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Normalised rows of video payloads (one JSON answer a row)."""
    schema = "items array<struct<id: string, snippet: struct<title: string, description: string, publishedAt: string, channelId: string, channelTitle: string>, statistics: struct<viewCount: string, likeCount: string, commentCount: string>, contentDetails: struct<duration: string>>>"
    v = payloads.select(F.explode(F.from_json(column, schema)["items"]).alias("v"))
    n = lambda c: F.coalesce(keys.to_int(F.col(f"v.statistics.{c}")), F.lit(0)).cast("long")
    return v.select(
        F.col("v.id").alias("video_id"), keys.video_link(F.col("v.id")).alias("url"), F.coalesce("v.snippet.title", F.lit("")).alias("title"), F.coalesce("v.snippet.description", F.lit("")).alias("description"),
        times.parse_iso(F.col("v.snippet.publishedAt")).alias("created_at_ts"), F.col("v.snippet.channelId").alias("channel_id"), F.col("v.snippet.channelTitle").alias("channel_title"),
        F.col("v.contentDetails.duration").alias("duration_iso"), times.duration_seconds(F.col("v.contentDetails.duration")).alias("duration_seconds"), n("viewCount").alias("view_count"), n("likeCount").alias("like_count"), n("commentCount").alias("comment_count"),
    )


def api_threads(payloads: DataFrame, column: str = "payload", video: str = "video_id") -> DataFrame:
    """Top-level comments of thread payloads, with their number of replies."""
    inner = "struct<publishedAt: string, textDisplay: string, textOriginal: string, likeCount: long>"
    schema = f"items array<struct<snippet: struct<totalReplyCount: int, topLevelComment: struct<id: string, snippet: {inner}>>>>"
    t = payloads.select(video, F.explode(F.from_json(column, schema)["items"]).alias("t"))
    c = "t.snippet.topLevelComment"
    return t.select(
        F.col(video).alias("video_id"), F.col(f"{c}.id").alias("comment_id"), F.lit(None).cast("string").alias("parent_comment_id"), F.coalesce(f"{c}.snippet.textOriginal", f"{c}.snippet.textDisplay").alias("text"),
        times.parse_iso(F.col(f"{c}.snippet.publishedAt")).alias("created_at_ts"), F.coalesce(f"{c}.snippet.likeCount", F.lit(0)).cast("long").alias("like_count"), F.coalesce("t.snippet.totalReplyCount", F.lit(0)).alias("reply_count"),
    )


def api_replies(payloads: DataFrame, column: str = "payload", video: str = "video_id") -> DataFrame:
    """Replies of reply payloads, in the columns of ``api_threads``."""
    inner = "struct<publishedAt: string, parentId: string, textDisplay: string, textOriginal: string, likeCount: long>"
    r = payloads.select(video, F.explode(F.from_json(column, f"items array<struct<id: string, snippet: {inner}>>")["items"]).alias("r"))
    return r.select(
        F.col(video).alias("video_id"), F.col("r.id").alias("comment_id"), F.col("r.snippet.parentId").alias("parent_comment_id"), F.coalesce("r.snippet.textOriginal", "r.snippet.textDisplay").alias("text"),
        times.parse_iso(F.col("r.snippet.publishedAt")).alias("created_at_ts"), F.coalesce("r.snippet.likeCount", F.lit(0)).cast("long").alias("like_count"), F.lit(0).alias("reply_count"),
    )


def search_pages(payloads: DataFrame, column: str = "payload", by: list[str] = (), page: str = "page") -> DataFrame:
    """``(by, page, position, video_id, last)`` of the ids of search pages up to the first that is empty or names no next page."""
    parsed = F.from_json(column, "items array<struct<id: struct<videoId: string>>>, nextPageToken string")
    ids = F.filter(F.coalesce(parsed["items"]["id"]["videoId"], F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
    rows = payloads.select(*by, page, ids.alias("ids"), F.coalesce(parsed["nextPageToken"], F.lit("")).alias("next"))
    order = Window.partitionBy(*by).orderBy(page) if by else Window.partitionBy(F.lit(0)).orderBy(page)
    ended = F.coalesce(F.max(F.when((F.size("ids") == 0) | (F.col("next") == ""), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = rows.withColumn("_ended", ended).filter((F.col("_ended") == 0) & (F.size("ids") > 0))
    return live.select(*by, page, F.posexplode("ids").alias("position", "video_id"), (F.col("next") == "").alias("last"))


def request_chunks(ids: DataFrame, by: list[str], order: list[str], id_: str = "video_id", size: int = 50) -> DataFrame:
    """``(by, chunk, ids)``: the distinct ids of each group in ``order``, comma-joined in requests of ``size``."""
    first = ids.groupBy(*by, id_).agg(F.min(F.struct(*order)).alias("_at"))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_at", id_)) - 1
    rows = first.withColumn("_n", number).withColumn("chunk", F.floor(F.col("_n") / size).cast("int"))
    return rows.groupBy(*by, "chunk").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", id_)))[id_], ",").alias("ids"))


def since(messages: DataFrame, start: str, ts: str = "created_at_ts", text: str = "text") -> DataFrame:
    """What a crawl from newest to oldest keeps: messages no earlier than ``start`` whose text is not blank."""
    return messages.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & keys.blank_to_null(F.col(text)).isNotNull())


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines through the commit protocol; times in ISO form, decimals as numbers."""
    rows.write.mode("overwrite").options(**_JSON).json(path)


def append_new(rows: DataFrame, path: str, key: str = "task_id") -> int:
    """Append the rows whose ``key`` the JSON lines below ``path`` lack, and return how many: a run that was stopped goes on
    where it was."""
    spark = rows.sparkSession
    store = Store(spark, path)
    fresh = rows
    if any(n.endswith(".json") for n in store.names()):
        done = spark.read.schema(rows.select(key).schema).json(path).select(key).distinct()
        fresh = rows.join(done, key, "left_anti").select(*rows.columns)
    fresh = materialise(fresh.dropDuplicates([key]), "append")
    fresh.write.mode("append").options(**_JSON).json(path)
    return fresh.count()


def write_json_document(rows: DataFrame, folder: str, name: str, head: dict | None = None, array: str = "posts", order: list[str] = ()) -> int:
    """One document ``{head..., array: [rows], "post_count": n}`` that appears under ``name`` whole or not at all.

    Rows stream to the file partition by partition, so the driver holds one partition's rows; nulls are written as such.
    """
    lines = (rows.orderBy(*order) if order else rows).select(F.to_json(F.struct("*"), {**_JSON, "ignoreNullFields": "false"}).alias("j"))
    written = 0

    def parts():
        nonlocal written
        yield ("{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)},\n" for k, v in (head or {}).items()) + f"{json.dumps(array)}: [").encode()
        for row in lines.toLocalIterator():
            yield ((",\n" if written else "\n") + row["j"]).encode()
            written += 1
        yield f'\n],\n"post_count": {written}}}\n'.encode()

    Store(rows.sparkSession, folder).put(name, _buffered(parts()))
    return written


def _buffered(parts, size: int = 1 << 20):
    held = bytearray()
    for part in parts:
        held += part
        if len(held) >= size:
            yield bytes(held)
            held.clear()
    yield bytes(held)


def write_report(rows: DataFrame, columns: list[str], path: str) -> None:
    """A text report, one line a row."""
    rows.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value")).write.mode("overwrite").text(path)
