"""Identifiers, keys, URLs and safe casts as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewell.functions import arrays


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def post_key(platform: Column, key1: Column, key2: Column) -> Column:
    """``platform:key1`` with ``:key2`` for platforms of two keys; key2 is '' for the others."""
    return F.when(F.coalesce(key2, F.lit("")) == "", F.concat_ws(":", platform, key1)).otherwise(F.concat_ws(":", platform, key1, key2))


def submission_id(raw: Column) -> Column:
    """A submission id in its prefixed form; blank ids and ids of comments raise."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(s == "", F.raise_error(F.lit("missing submission id"))).when(s.startswith("t1_"), F.raise_error(F.lit("id of a comment where one of a submission is due"))).when(s.startswith("t3_"), s).otherwise(F.concat(F.lit("t3_"), s))


def parent_comment_id(raw: Column) -> Column:
    """The parent comment's prefixed id; null where the parent is the submission, or blank."""
    s = F.trim(raw)
    return F.when(s.isNull() | (s == "") | s.startswith("t3_"), F.lit(None).cast("string")).when(s.startswith("t1_"), s).otherwise(F.concat(F.lit("t1_"), s))


def bare_id(raw: Column) -> Column:
    return F.regexp_replace(raw, "^t[13]_", "")


def episode_id(podcast_id: Column, guid: Column, url: Column, created: Column, title: Column) -> Column:
    """Stable id from the first of guid, url, and time with title that is not blank."""
    pid = podcast_id.cast("string")
    fallback = F.concat(F.coalesce(F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("")), F.lit(":"), F.coalesce(title, F.lit("")))
    token = F.coalesce(blank_to_null(guid), blank_to_null(url), fallback)
    return F.concat(F.lit("ep_"), pid, F.lit("_"), F.md5(F.concat(pid, F.lit(":"), token).cast("binary")))


def task_id(source_post: Column, chunk: Column, post: Column, text: Column) -> Column:
    """``post:chunk`` where both are known, else the post with a short digest of its text."""
    p = F.coalesce(post.cast("string"), F.lit("unknown"))
    digest = F.substring(F.sha2(F.concat(p, F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"), 256), 1, 16)
    return F.coalesce(F.concat(source_post.cast("string"), F.lit(":"), chunk.cast("string")), F.concat(p, F.lit(":"), digest))


def domain(url: Column) -> Column:
    """The third part between slashes; '' where there is none."""
    return F.split_part(url, F.lit("/"), F.lit(3))


# Forms of links that must match the platforms' own: fixed values.


def telegram_link(channel: Column, channel_id: Column, message_id: Column) -> Column:
    """Public link by name, or the private form by numeric id."""
    return F.when(blank_to_null(channel).isNotNull(), F.concat_ws("/", F.lit("https://t.me"), channel, message_id.cast("string"))).otherwise(F.concat_ws("/", F.lit("https://t.me/c"), channel_id.cast("string"), message_id.cast("string")))


def video_link(video_id: Column, comment_id: Column | None = None) -> Column:
    base = F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)
    return base if comment_id is None else F.when(comment_id.isNull(), base).otherwise(F.concat(base, F.lit("&lc="), comment_id))


#: Endings of audio files: fixed values.
AUDIO_ENDINGS = ("mp3", "m4a", "wav", "aac")


def audio_candidates(url: Column) -> Column:
    """Audio file URLs hidden in a tracking URL, deepest first, without query strings, distinct.

    What stands before the last audio ending of the decoded URL is taken apart at slashes; every part that reads like a
    host name begins a candidate that runs to that ending.
    """
    path = F.regexp_extract(F.regexp_replace(F.try_url_decode(url), r"[\s\"'].*$", ""), rf"(?i)^.*[^/][.](?:{'|'.join(AUDIO_ENDINGS)})", 0)
    host = lambda part: part.rlike(r"(?i)^[a-z0-9.-]+[.][a-z]{2,}$")

    def of(parts: Column) -> Column:
        last = F.size(parts)
        begins = F.filter(F.sequence(last - 1, F.lit(0), F.lit(-1)), lambda k: (k < last - 1) & host(F.get(parts, k)))
        whole = lambda k: F.concat(F.lit("https://"), F.array_join(F.slice(parts, k + 1, last - k), "/"))
        return F.array_distinct(F.transform(begins, lambda k: F.split_part(whole(k), F.lit("?"), F.lit(1))))

    return F.when(F.try_url_decode(url).isNotNull(), arrays.let(F.split(path, "/", -1), of))


def to_int(raw: Column) -> Column:
    return F.trim(raw).try_cast("bigint")


def to_bool(raw: Column) -> Column:
    return F.coalesce(F.lower(F.trim(raw)).isin("true", "t", "1", "yes", "y"), F.lit(False))


def json_or_text(raw: Column) -> Column:
    """Canonical JSON where the text parses, the text itself otherwise."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), raw)
