"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, in DataFrame operations only.

Words stand for tokens. Every source gets a target (weights by code point order, capped at ``MAX_REPEATS`` times its
size, the excess shared again by weight). The mix's total is cut into blocks of ``BLOCK`` words; the blocks go to the
sources by highest quotients ``target / (2 k - 1)``, each source's to its groups of ``GROUP`` shards by the groups' sizes in
the same way, and each group's to its shards. Within a shard documents stand in a seeded order, and the shard's words along that
line are numbered blocks. A quota takes all blocks as often as it holds their number; the rest is drawn by seed, in
stretches of ``STRETCH`` blocks so that most documents stay whole, the last stretch in part.

Only the tables of sources and of a source's groups of shards are ranked as a whole (a group is hundreds of millions of
words); groups and shards bound every other window, and a hot source is many of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions import arrays
from tidewell.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
#: Words of a block, and about how many words a shard has.
BLOCK = 16
SHARD_WORDS = 250_000
#: Shards of a group that is ranked together, and blocks that are drawn together.
GROUP, STRETCH = 1024, 128
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int = SEED, carry: bool = False) -> DataFrame:
    """Size, join key of the source and place in the seeded order of every row; with ``carry`` its columns as ``row``.

    The place is a digest of id and text, so rows of one id (or none) are spread like any others.
    """
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count().alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).cast("binary")).alias("place"),
        F.xxhash64("text").alias("tie"),
        *own,
    )


def apportion(votes: DataFrame, group: list[str], vote: str, seats: Column, tie: list[Column]) -> DataFrame:
    """Sainte-Lague seats of each row of ``votes`` within its group, as column ``won``.

    ``seats`` is the group's number of seats. Any divisor rule seats lie between those of two divisors around
    votes / seats, so only the quotients in between are ranked: about two a row, however many seats there are.
    Ties go by ``tie``.
    """
    whole = Window.partitionBy(*group)
    rows = votes.withColumns({"_seats": seats, "_votes": F.sum(vote).over(whole), "_rows": F.count("*").over(whole)})
    at = lambda n: F.when((F.col("_votes") > 0) & (n > 0), F.floor(F.col(vote) / F.col("_votes") * n + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("_low", F.greatest(F.lit(0).cast("long"), at(F.col("_seats") - F.col("_rows") / 2) - 1)).withColumn("_high", at(F.col("_seats") + F.col("_rows") / 2) + 2)
    rows = rows.withColumn("_open", F.col("_seats") - F.sum("_low").over(whole))
    offers = rows.select("*", F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("_k"))
    ranked = offers.withColumn("_rank", F.row_number().over(whole.orderBy((F.col(vote) / (2 * F.col("_k") - 1)).desc(), *tie, F.col("_k"))))
    won = F.sum(F.when((F.col("_rank") <= F.col("_open")) & (F.col("_votes") > 0), 1).otherwise(0)) + F.first("_low")
    return ranked.groupBy(*votes.columns).agg(won.cast("long").alias("won"))


def source_plan(rows: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a source: size, target, blocks won and number of shards."""
    sizes = rows.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1)
    s = sizes.withColumns({"rank": rank, "weight": weight, "total": F.sum("source_size").over(everything) * F.lit(SHARE), "cap": F.col("source_size") * MAX_REPEATS})
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped, weighed = F.sum("cap").over(filled) - F.col("cap"), F.sum("weight").over(filled) - F.col("weight")
    # water level if all sources before this one stand at their cap; the true level is the highest of these
    s = s.withColumn("level", (F.col("total") - capped) / (F.sum("weight").over(everything) - weighed))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(everything) * F.col("weight")))
    s = s.select(F.lit(1).alias("one"), "skey", "source_size", "rank", "target", F.floor(F.col("total") / block + 0.5).alias("blocks"))
    won = apportion(s, ["one"], "target", F.col("blocks"), [F.col("rank")])
    return won.select("skey", "source_size", "target", "won", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words)).alias("shards"))


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    number = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    return rows.join(plan, "skey").withColumn("shard", F.pmod(number, F.col("shards")))


def shard_plan(placed: DataFrame, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row a shard: its words, and how many blocks of them its quota takes."""
    sizes = placed.groupBy("skey", "shard").agg(F.sum("size").alias("line"), F.first("won").alias("blocks"))
    sizes = materialise(sizes.withColumn("grp", F.floor(F.col("shard") / group)), "shards")
    groups = sizes.groupBy("skey", "grp").agg(F.sum("line").alias("words"), F.first("blocks").alias("blocks"))
    to_groups = apportion(groups, ["skey"], "words", F.col("blocks"), [F.col("grp")]).select("skey", "grp", F.col("won").alias("seats"))
    shards = sizes.drop("blocks").join(to_groups, ["skey", "grp"])
    won = apportion(shards, ["skey", "grp"], "line", F.col("seats"), [F.col("shard")])
    return won.select("skey", "shard", "line", F.least(F.col("won") * block, F.col("line") * MAX_REPEATS).alias("quota"))


def drawn(quotas: DataFrame, block: int = BLOCK, stretch: int = STRETCH, seed: int = SEED) -> DataFrame:
    """``quotas`` with full (passes over the whole shard) and takes: of each stretch of its line, the words that the rest of
    the quota takes from its beginning.

    Stretches are drawn in the order of a seeded digest until the rest is filled.
    """
    words = block * stretch
    full = F.when(F.col("line") > 0, F.floor(F.col("quota") / F.col("line"))).otherwise(0).cast("long")
    rows = quotas.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("line"))
    digest = lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("skey", F.lit("")), F.col("shard").cast("string"), k.cast("string")).cast("binary"))
    stretches = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("line") - 1) / words)), lambda k: F.struct(digest(k).alias("d"), k.alias("k"), F.least(F.col("line") - k * words, F.lit(words)).alias("w")))
    rows = rows.withColumn("_line", F.when(F.col("rest") > 0, F.array_sort(stretches)).otherwise(F.array().cast("array<struct<d: string, k: bigint, w: bigint>>")))
    ends = arrays.running_sums(F.transform("_line", lambda s: s["w"]))
    takes = F.zip_with("_line", ends, lambda s, end: F.struct(s["k"].alias("k"), F.greatest(F.lit(0), F.least(s["w"], F.col("rest") - end + s["w"])).alias("w")))
    return rows.withColumn("takes", F.transform(F.array_sort(takes), lambda s: s["w"])).select("skey", "shard", "line", "full", "takes")


def _taken(placed: DataFrame, quotas: DataFrame, words: int) -> DataFrame:
    """Adds full (whole passes) and ranges: from the rest of the quota, ``{start, end}`` of the words of each row."""
    line = Window.partitionBy("skey", "shard").orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.join(quotas, ["skey", "shard"]).withColumn("_before", F.sum("size").over(line) - F.col("size"))
    stretches = F.sequence(F.floor(F.col("_before") / words), F.floor((F.col("_before") + F.col("size") - 1) / words))
    begin = lambda k: F.greatest(k * words - F.col("_before"), F.lit(0))
    end = lambda k: F.least(k * words + F.get("takes", k.cast("int")) - F.col("_before"), F.col("size"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    found = F.filter(F.transform(stretches, lambda k: F.struct(begin(k).alias("start"), end(k).alias("end"))), lambda r: r["end"] > r["start"])
    return rows.withColumn("ranges", F.when((F.col("size") > 0) & (F.size("takes") > 0), found).otherwise(none))


def _in_ranges() -> Column:
    return F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def _plan(docs: DataFrame, block: int, shard_words: int, stretch: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of ``docs``, the table of sources and the table of shards, each written once."""
    rows = materialise(sized(docs, seed), "sizes")
    plan = materialise(source_plan(rows, block, shard_words), "sources")
    return rows, plan, materialise(drawn(shard_plan(_placed(rows, plan), block), block, stretch, seed), "quotas")


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, stretch: int = STRETCH, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    Null texts have size 0 and a null source is a source, last in order; repeated rows are rows of their own, and those that
    are equal in id and text stand side by side in their shard; a very long text may be several stretches. Other columns are
    ignored. An empty table, or one without words, takes nothing, and so does one of so few words that its total rounds
    to no block (fewer than 6 of ``BLOCK`` 16).
    """
    rows, plan, quotas = _plan(docs, block, shard_words, stretch, seed)
    taken = _taken(_placed(rows, plan), quotas, block * stretch)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + _in_ranges()).alias("taken"))


def mixture(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, stretch: int = STRETCH, seed: int = SEED) -> DataFrame:
    """The mix itself: a row for each pass that takes words of a document, in the columns of ``docs``.

    A document of which a pass takes a part keeps the words in that part, with n_chars (if there is such a column) set anew.
    Documents of which nothing is taken do not occur: those with null texts, and all of a table too small for a block. Very
    long texts are cut like others; repeated rows are rows of their own.
    """
    _, plan, quotas = _plan(docs, block, shard_words, stretch, seed)
    out = _taken(_placed(sized(docs, seed, carry=True), plan), quotas, block * stretch).filter("size > 0")
    whole = F.array_repeat(F.lit(True), F.col("full").cast("int") + (_in_ranges() == F.col("size")).cast("int"))
    part = F.when((_in_ranges() > 0) & (_in_ranges() < F.col("size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    out = out.select("row", "ranges", F.explode(F.concat(whole, part)).alias("all"))
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = arrays.let(pieces, lambda p: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(p, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), ""))
    out = out.withColumn("cut", F.when(F.col("all"), F.col("row.text")).otherwise(cut))
    changed = {"text": F.col("cut"), "n_chars": F.when(F.col("all"), F.col("row.n_chars")).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place FROM documents
), s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), s1 AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total, source_size * 2 AS cap FROM s0
), s2 AS (SELECT *, (total - CAST(sum(cap) OVER f - cap AS DOUBLE)) / CAST(sum(weight) OVER () - (sum(weight) OVER f - weight) AS DOUBLE) AS level
  FROM s1 WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, rank ROWS UNBOUNDED PRECEDING)
), s3 AS (SELECT source, source_size, rank, least(CAST(cap AS DOUBLE), max(level) OVER () * weight) AS target, CAST(floor(total / {BLOCK} + 0.5) AS BIGINT) AS blocks,
  greatest(1, CAST(ceil(CAST(source_size AS DOUBLE) / {SHARD_WORDS}) AS BIGINT)) AS shards FROM s2
), s4 AS (SELECT *, CAST(floor(target / sum(target) OVER () * blocks) AS BIGINT) AS near, count(*) OVER () AS n FROM s3
), s5 AS (SELECT *, greatest(near - n, 0) AS low FROM s4), s6 AS (SELECT *, blocks - sum(low) OVER () AS open FROM s5
), s7 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS place FROM (SELECT *, unnest(range(low + 1, near + n + 2)) AS k FROM s6)
), plan AS (SELECT source, source_size, target, shards, CAST(any_value(low) + count(*) FILTER (place <= open) AS BIGINT) AS won FROM s7 GROUP BY ALL
), p AS (SELECT d.*, plan.* EXCLUDE (source), CAST('0x' || substr(place, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
), q0 AS (SELECT source, shard, shard // {GROUP} AS grp, CAST(sum(size) AS BIGINT) AS line, any_value(won) AS blocks FROM p GROUP BY ALL
), g0 AS (SELECT source, grp, CAST(sum(line) AS BIGINT) AS words, any_value(blocks) AS blocks FROM q0 GROUP BY ALL
), g1 AS (SELECT *, CAST(floor(CAST(words AS DOUBLE) / CAST(sum(words) OVER s AS DOUBLE) * blocks) AS BIGINT) AS near, count(*) OVER s AS n FROM g0 WINDOW s AS (PARTITION BY source)
), g2 AS (SELECT *, greatest(near - n, 0) AS low FROM g1), g3 AS (SELECT *, blocks - sum(low) OVER (PARTITION BY source) AS open FROM g2
), g4 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(words AS DOUBLE) / (2 * k - 1) DESC, grp, k) AS place FROM (SELECT *, unnest(range(low + 1, near + n + 2)) AS k FROM g3)
), g AS (SELECT source, grp, any_value(low) + count(*) FILTER (place <= open) AS seats FROM g4 GROUP BY source, grp
), q1 AS (SELECT q0.* EXCLUDE (blocks), seats, CAST(floor(CAST(line AS DOUBLE) / CAST(sum(line) OVER s AS DOUBLE) * seats) AS BIGINT) AS near, count(*) OVER s AS n
  FROM q0 JOIN g ON q0.source IS NOT DISTINCT FROM g.source AND q0.grp = g.grp WINDOW s AS (PARTITION BY q0.source, q0.grp)
), q2 AS (SELECT *, greatest(near - n, 0) AS low FROM q1), q3 AS (SELECT *, seats - sum(low) OVER (PARTITION BY source, grp) AS open FROM q2
), q4 AS (SELECT *, row_number() OVER (PARTITION BY source, grp ORDER BY CAST(line AS DOUBLE) / (2 * k - 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(low + 1, near + n + 2)) AS k FROM q3)
), quota AS (SELECT source, shard, line, CAST(least(({BLOCK} * (any_value(low) + count(*) FILTER (place <= open))), 2 * line) AS BIGINT) AS quota FROM q4 GROUP BY source, shard, line
), f AS (SELECT *, CASE WHEN line > 0 THEN quota // line ELSE 0 END AS whole, CASE WHEN line > 0 THEN quota % line ELSE 0 END AS rest FROM quota
), st AS (SELECT *, least(line - k * {BLOCK * STRETCH}, {BLOCK * STRETCH}) AS w FROM (SELECT source, shard, line, rest, unnest(range(0, (line - 1) // {BLOCK * STRETCH} + 1)) AS k FROM f WHERE rest > 0)
), dr AS (SELECT *, sum(w) OVER (PARTITION BY source, shard ORDER BY md5('{SEED}:' || coalesce('=' || source, '') || ':' || shard || ':' || k) ROWS UNBOUNDED PRECEDING) AS upto FROM st
), tk AS (SELECT source, shard, k, greatest(0, least(w, rest - upto + w)) AS w FROM dr
), t AS (SELECT p.*, line, whole, row_number() OVER () AS rid, sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM p JOIN f ON p.source IS NOT DISTINCT FROM f.source AND p.shard = f.shard
), ov AS (SELECT rid, sum(greatest(0, least(tk.k * {BLOCK * STRETCH} + tk.w, before + size) - greatest(tk.k * {BLOCK * STRETCH}, before))) AS part
  FROM t JOIN tk ON t.source IS NOT DISTINCT FROM tk.source AND t.shard = tk.shard AND tk.k BETWEEN before // {BLOCK * STRETCH} AND (before + size - 1) // {BLOCK * STRETCH} WHERE size > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(whole * size + coalesce(part, 0) AS BIGINT) AS taken FROM t LEFT JOIN ov USING (rid)
"""
