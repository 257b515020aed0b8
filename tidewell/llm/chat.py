"""Multi-party chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and the
others as named users; only the assistant's contents are marked for the loss. Long conversations come in parts of
``PART_TURNS`` turn numbers, and a part of many rows (turns that repeat or are null) in pieces of about as many rows, so no
task gathers a conversation: parts and pieces in order make the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import arrays
from tidewell.session import materialise

PART_TURNS = 64
#: Rows of a part, beyond which it comes in pieces of about ``PART_TURNS`` rows.
MOST_ROWS = 256
#: Rows of the table of such parts that is sent along; a larger one is joined by key.
SENT_ROWS = 50_000
#: Roles that address all and are never a perspective.
SYSTEM = "system"
UNNAMED = "unknown"


def _clean(text: Column) -> Column:
    """Contents cannot open a marker of the format."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _name(speaker: Column) -> Column:
    """A speaker's name on one line, which can neither open a marker nor close its own."""
    own = F.replace(F.translate(_clean(speaker), "\r\n", "  "), F.lit("|>"), F.lit("| >"))
    return F.when(own.endswith("<"), F.concat(own, F.lit(" "))).otherwise(own)


def _head(speaker: Column, perspective: Column) -> Column:
    return F.when(speaker == SYSTEM, "<|system|>\n").when(speaker == perspective, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), _name(speaker), F.lit("|>\n")))


def _pieces(turns: DataFrame, part_turns: int, most_rows: int) -> DataFrame:
    """``turns`` with the column piece: 0, or within parts of many rows the turn's place and a range of digests.

    Such parts are found by counts alone. Rows of one turn number are dealt by the leading digits of their digest, by
    which they are ordered, so pieces are in order and rows that repeat stay together.
    """
    many = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("conv_id", "part")
    many = materialise(many, "parts")
    if not many.head(1):
        return turns.withColumn("piece", F.lit(0).cast("long"))
    sent = lambda t: F.broadcast(t) if len(t.take(SENT_ROWS + 1)) <= SENT_ROWS else t.hint("merge")
    cuts = turns.join(sent(many), ["conv_id", "part"], "left_semi").groupBy("conv_id", "part", F.coalesce("turn", F.lit(-1)).alias("at")).agg(F.ceil(F.count("*") / part_turns).alias("cuts"))
    cuts = materialise(cuts, "cuts")
    rows = turns.withColumn("at", F.coalesce("turn", F.lit(-1))).join(sent(cuts), ["conv_id", "part", "at"], "left")
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    within = F.shiftrightunsigned(place * F.col("cuts"), 32)
    piece = F.shiftleft(F.coalesce(F.col("turn") - F.col("part") * part_turns, F.lit(0)), 32) + within + 1
    return rows.withColumn("piece", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(piece).cast("long")).select(*turns.columns, "piece")


def _rendered(rows: DataFrame) -> DataFrame:
    pieces = F.transform("turns", lambda t: F.struct(_head(t["role"], F.col("perspective")).alias("head"), _clean(t["text"]).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    rows = rows.select("conv_id", "perspective", "part", "piece", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    ends = arrays.running_sums(F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["body"]) + 8))
    spans = F.zip_with("pieces", ends, lambda p, end: F.when(p["own"], F.concat((end - 8 - F.length(p["body"])).cast("string"), F.lit(":"), (end - 8).cast("string"))))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("<|end|>\n"))), "")
    return rows.select("conv_id", "perspective", "part", "piece", "n_turns", text.alias("text"), F.array_join(spans, ",").alias("mask"))


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS, most_rows: int = MOST_ROWS) -> DataFrame:
    """``(conv_id, perspective, part, piece, n_turns, text, mask)``: a row for each participant and piece of a conversation.

    mask lists ``start:end`` (code points of text, end exclusive) of the assistant's contents, comma-joined. Turns
    are ordered by turn (null first, in part -1), then by a digest of speaker and text; exactly repeated rows are one turn.
    A null role is the speaker "unknown", a null text is empty. Of a row without conversation id nothing tells which others
    belong to it, so it is a conversation of its own. Very long texts are one turn like any other; columns other than
    conv_id, turn, role and text are ignored. A conversation of system turns only has no perspective and so no row, and
    an empty table gives an empty result.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.md5(F.concat(role, F.lit("\n"), text).cast("binary")).alias("digest"),
        F.coalesce(F.floor(F.col("turn").cast("long") / part_turns), F.lit(-1)).cast("long").alias("part"),
    )
    line = lambda rows: F.struct(*(rows[c] for c in ("turn", "digest", "role", "text")))
    known, apart = turns.filter("conv_id is not null"), turns.filter("conv_id is null")
    cut = _pieces(known, part_turns, most_rows)
    # sets are built within tasks first, so rows that repeat are not gathered, and texts meet their piece in one shuffle
    parts = cut.groupBy("conv_id", "part", "piece").agg(F.array_sort(F.collect_set(line(cut))).alias("turns"))
    speakers = known.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective")).distinct()
    rows = parts.join(speakers, "conv_id").select("conv_id", "part", "piece", "turns", "perspective")
    alone = apart.filter(F.col("role") != SYSTEM).dropDuplicates(["turn", "role", "digest"])
    alone = alone.select("conv_id", "part", F.lit(0).cast("long").alias("piece"), F.array(line(alone)).alias("turns"), F.col("role").alias("perspective"))
    return _rendered(rows.unionByName(alone))


ORACLE_SQL = f"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS role, coalesce(text, '') AS text, coalesce(CAST(floor(turn / {PART_TURNS}.0) AS BIGINT), -1) AS part FROM conversations),
c AS (SELECT *, md5(role || chr(10) || text) AS digest, count(*) OVER (PARTITION BY conv_id, part) AS n, count(*) OVER (PARTITION BY conv_id, part, turn) AS m FROM raw),
t AS (
  SELECT DISTINCT conv_id, turn, role, text, part, digest, CASE WHEN conv_id IS NULL OR n <= {MOST_ROWS} THEN 0
    ELSE coalesce(turn - part * {PART_TURNS}, 0) * 4294967296 + CAST('0x' || substr(digest, 1, 8) AS BIGINT) * CAST(ceil(m / {PART_TURNS}.0) AS BIGINT) // 4294967296 + 1 END AS piece FROM c
), s AS (SELECT DISTINCT conv_id AS own, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
j AS (
  SELECT t.*, perspective, '' AS alone FROM t JOIN s ON conv_id = own
  UNION ALL SELECT t.*, role, coalesce(CAST(turn AS VARCHAR), '') || ':' || digest FROM t WHERE conv_id IS NULL AND role <> '{SYSTEM}'
), p AS (
  SELECT *, role = perspective AS mine, replace(text, '<|', '< |') AS body,
    CASE WHEN role = '{SYSTEM}' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
      ELSE '<|user name=' || replace(translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  '), '|>', '| >') || CASE WHEN role LIKE '%<' THEN ' ' ELSE '' END || '|>' || chr(10) END AS head
  FROM j
), o AS (
  SELECT *, CAST(sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id, alone, perspective, part, piece ORDER BY turn NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) - 8 AS stop FROM p
)
SELECT conv_id, perspective, part, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns, string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, digest) AS text,
  coalesce(string_agg(CASE WHEN mine THEN (stop - length(body)) || ':' || stop END, ',' ORDER BY turn NULLS FIRST, digest), '') AS mask
FROM o GROUP BY conv_id, alone, perspective, part, piece
"""
