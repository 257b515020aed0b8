"""The registry of posts and the unified view over all platforms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidewell.functions import keys
from tidewell.session import numbered


@dataclass(frozen=True)
class Platform:
    """How a platform's table maps to the unified columns; a key2 of None is stored as ''."""

    name: str
    key1: str
    key2: str | None
    text: str
    metric: str | None
    url: str | None


#: The platforms of the unified view: fixed values.
PLATFORMS = (
    Platform("tweet", "id", None, "filtered_text", "like_count", None),
    Platform("reddit_submission", "id", None, "filtered_text", "score", "permalink"),
    Platform("reddit_comment", "id", None, "filtered_text", "score", "permalink"),
    Platform("telegram_post", "channel_id", "message_id", "filtered_text", "views", "link"),
    Platform("youtube_video", "video_id", None, "transcript", "view_count", "url"),
    Platform("youtube_comment", "video_id", "comment_id", "filtered_text", "like_count", "comment_url"),
    Platform("podcast_episode", "id", None, "transcript", None, "download_url"),
    Platform("news_article", "id", None, "text", None, "url"),
)


def source_keys(source: DataFrame, platform: Platform) -> DataFrame:
    key2 = F.lit("") if platform.key2 is None else F.col(platform.key2).cast("string")
    return source.select(F.lit(platform.name).alias("platform"), F.col(platform.key1).cast("string").alias("key1"), key2.alias("key2"))


def register(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """New registry rows ``(id, platform, key1, key2, post_key)`` for keys that are not registered yet.

    Ids continue after the largest so far in the order of platform and keys, as cursors rely on ids that only grow.
    Key parts that are null never register.
    """
    fresh = candidates.filter("platform is not null and key1 is not null and key2 is not null").dropDuplicates(["platform", "key1", "key2"])
    fresh = fresh.join(registry, ["platform", "key1", "key2"], "left_anti")
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    fresh = numbered(fresh.select("platform", "key1", "key2"), ["platform", "key1", "key2"], "id", top)
    return fresh.select("id", "platform", "key1", "key2", keys.post_key(F.col("platform"), F.col("key1"), F.col("key2")).alias("post_key"))


def posts_all(registry: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """One row for each registered post that its source table still has, in the unified columns.

    Branches join on the platform's keys (key2 = '' where there is one key) and are united by name.
    """

    def branch(p: Platform) -> DataFrame:
        s = sources[p.name]
        has = lambda c: F.col(f"s.{c}") if c in s.columns else F.lit(None)
        mine = registry.filter(F.col("platform") == p.name).alias("r")
        on = F.col("r.key1") == F.col(f"s.{p.key1}").cast("string")
        on = on & (F.col("r.key2") == (F.lit("") if p.key2 is None else F.col(f"s.{p.key2}").cast("string")))
        return mine.join(s.alias("s"), on).select(
            F.col("r.id").alias("post_id"), "r.platform", "r.key1", "r.key2",
            has("date_entered").cast("timestamp").alias("date_entered"), has("created_at_ts").cast("timestamp").alias("created_at_ts"),
            F.col(f"s.{p.text}").alias("text"), has("is_en").cast("boolean").alias("is_en"),
            (F.col(f"s.{p.metric}") if p.metric else F.lit(None)).cast("bigint").alias("primary_metric"),
            (F.col(f"s.{p.url}") if p.url else F.lit(None)).cast("string").alias("url"),
        )

    return reduce(DataFrame.unionByName, [branch(p) for p in PLATFORMS if p.name in sources])


def english(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("is_en").eqNullSafe(F.lit(True)))


def orphans(registry: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Registered keys whose source row is gone."""
    found = reduce(DataFrame.unionByName, [source_keys(sources[p.name], p) for p in PLATFORMS if p.name in sources])
    return registry.filter(F.col("platform").isin(*sources)).join(found, ["platform", "key1", "key2"], "left_anti")


def duplicates(registry: DataFrame) -> DataFrame:
    """Rows after the first of each key, in id order."""
    rank = F.row_number().over(Window.partitionBy("platform", "key1", "key2").orderBy("id"))
    return registry.withColumn("rank", rank).filter("rank > 1").drop("rank")


def enrich(posts: DataFrame, submissions: DataFrame, comments: DataFrame, videos: DataFrame, episodes: DataFrame, shows: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Titles and names that a post's platform has; ids of submissions compare without their prefix."""
    p = posts.alias("p")
    is_ = lambda name: F.col("p.platform") == name
    s1 = submissions.select(keys.bare_id(F.col("id")).alias("id1"), F.col("title").alias("reddit_submission_title"))
    c = comments.select(F.col("id").alias("cid"), keys.bare_id(F.col("link_id")).alias("clink"))
    s2 = submissions.select(keys.bare_id(F.col("id")).alias("id2"), F.col("title").alias("reddit_comment_submission_title"))
    v = videos.select(F.col("video_id").alias("vid"), F.col("title").alias("youtube_video_title"))
    e = episodes.select(F.col("id").alias("eid"), "podcast_id")
    w = shows.select(F.col("id").alias("sid"), F.col("title").alias("podcast_name"))
    out = p.join(s1, is_("reddit_submission") & (keys.bare_id(F.col("p.key1")) == F.col("id1")), "left")
    out = out.join(c, is_("reddit_comment") & (F.col("p.key1") == F.col("cid")), "left").join(s2, F.col("clink") == F.col("id2"), "left")
    out = out.join(v, is_("youtube_video") & (F.col("p.key1") == F.col("vid")), "left")
    out = out.join(e, is_("podcast_episode") & (F.col("p.key1") == F.col("eid")), "left").join(w, F.col("podcast_id") == F.col("sid"), "left")
    names = ["reddit_submission_title", "reddit_comment_submission_title", "youtube_video_title", "podcast_name"]
    if channels is not None:
        t = channels.select(F.col("channel_id").cast("string").alias("tid"), F.col("name").alias("telegram_channel"))
        out, names = out.join(t, is_("telegram_post") & (F.col("p.key1") == F.col("tid")), "left"), [*names, "telegram_channel"]
    return out.select("p.*", *names)
