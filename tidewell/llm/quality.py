"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Base counts come from array functions inside each row, so no words are shuffled. The method fits a minimum-covariance-
determinant estimate per language and source to a vector of transformed statistics and rejects documents by their
Mahalanobis distance. Each group has several starts (medians and absolute deviations, all rows, and seeded parts of
them), which all take concentration steps: a step keeps the ``SUPPORT`` share of smallest distances and estimates again from
these rows. A start stops when its determinant no longer falls, and the group keeps the smallest determinant of all starts.
Supports are found by histograms of fixed bins, refined within the bin at the edge, and moments are summed
within tasks first, so a hot group costs no more than its rows' share.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.session import materialise

SUPPORT = 0.75
#: Starts: medians, all rows, and as many seeded parts of one row in ``PART``.
PARTS, PART = 2, 8
#: A start has settled when its determinant falls by less than this share; and the steps it may take at most.
SETTLED, MOST_STEPS = 1e-6, 60
#: Histogram bins an e-fold of distance, and finer bins within each.
BINS, FINE = 16, 4096
#: Makes the covariance of the closest 75 % of a five-dimensional normal sample consistent: 0.75 / F7(chi2_5^-1(0.75)).
CONSISTENCY = 1.41
#: Squared distance beyond which a document is rejected: the 99.9 % quantile of chi-squared with five degrees.
CUTOFF = 20.515
#: Documents that an estimate of its own needs; smaller groups are held against all of their language, or of the corpus.
MIN_GROUP = 60
#: Rows of a table of groups that is sent along; larger ones are joined by dealing both sides by key.
SENT_ROWS = 50_000
_SPACE = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
#: Transformed statistics, and the standard deviation that each has at least.
STATISTICS = {"x0": 0.5, "x1": 0.1, "x2": 0.08, "x3": 0.15, "x4": 0.12}
_D = len(STATISTICS)
_WINDOWS = "array<struct<h: bigint, a: string, b: string, c: string, i: int>>"
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]


def counts(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and the base counts of every whole text; null texts have no words.

    Words in repeated 3-word windows are found by sorting windows by hash, words and place, so a long text costs
    n log n, and windows are equal only if their words are.
    """
    carry = ["doc_id"] if carry is None else carry
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), text.alias("_text"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE + "+", -1)).alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    n = F.size("_words")
    second, third = F.slice("_words", F.lit(2), n), F.slice("_words", F.lit(3), n)
    pairs = F.zip_with("_words", second, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    windows = F.zip_with(F.slice(pairs, F.lit(1), F.greatest(n - 2, F.lit(0))), third, lambda p, z: F.struct(F.xxhash64(p["a"], p["b"], z).alias("h"), p["a"].alias("a"), p["b"].alias("b"), z.alias("c")))
    rows = rows.select(
        *(F.col(f"`{c}`") for c in carry),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(n < 4, F.array().cast(_WINDOWS)).otherwise(F.sort_array(F.transform(windows, lambda w, i: F.struct(w["h"].alias("h"), w["a"].alias("a"), w["b"].alias("b"), w["c"].alias("c"), i.alias("i"))))).alias("_sorted"),
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    equal = F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted"), F.lit(1))), same)  # as the next one
    rows = rows.withColumn("_equal", equal)
    twice = F.filter(F.zip_with("_sorted", F.zip_with("_equal", F.concat(F.array(F.lit(False)), "_equal"), lambda x, y: F.coalesce(x, F.lit(False)) | y), lambda w, t: F.when(t, w["i"].cast("long"))), lambda i: i.isNotNull())
    rows = rows.withColumn("_places", F.sort_array(twice))
    gaps = F.zip_with(F.slice("_places", F.lit(2), F.greatest(F.size("_places") - 1, F.lit(0))), F.slice("_places", F.lit(1), F.greatest(F.size("_places") - 1, F.lit(0))), lambda b, a: F.least(F.lit(3).cast("long"), b - a))
    repeated = F.when(F.size("_places") > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))
    return rows.select(
        *(F.col(f"`{c}`") for c in carry), "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """Length, mean word length, share of symbols, of equal lines and of repeated words, on scales near normal."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "x0": F.log1p("n_words"),
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x2": share("n_symbols", "word_chars"),
        "x3": share("n_dup_lines", "n_lines"),
        "x4": share("n_repeat_words", "n_words"),
    }


def _sent(groups: DataFrame) -> DataFrame:
    """``groups`` (written, a few rows a group), to be sent along if its rows are few, as a join that deals rows by group brings
    a hot group to one task. Beyond that it is a sort-merge join with the rows on its left, whose hot groups adaptive
    execution splits."""
    return F.broadcast(groups) if groups.limit(SENT_ROWS + 1).count() <= SENT_ROWS else groups.hint("merge")


def grouped(rows: DataFrame) -> DataFrame:
    """``(lang, source, grp)`` of each language and source of ``rows``: the group whose estimate its rows are held against.

    That is the source's own, or that of all rows of its language, or of all rows (``*``): the first of ``MIN_GROUP`` rows.
    """
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    lang = own.groupBy(F.col("lang").alias("lang2")).agg(F.sum("n").alias("m"))
    keys = own.join(lang, F.col("lang").eqNullSafe(F.col("lang2")))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    name = F.when(F.col("n") >= MIN_GROUP, F.concat(part("lang"), F.lit("\t"), part("source"))).when(F.col("m") >= MIN_GROUP, part("lang")).otherwise(F.lit("*"))
    return materialise(keys.select("lang", "source", name.alias("grp")), "groups")


def placed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` once for each group of ``keys`` that is estimated over them: their own, and those of their language and
    of all rows where some small group is held against these."""
    part = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    wide = keys.filter(F.col("grp") == part).select("grp").distinct()
    own = keys.filter((F.col("grp") != part) & (F.col("grp") != "*"))
    a = rows.join(_sent(materialise(own.withColumnsRenamed({"lang": "l", "source": "s"}), "own")), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")
    out = a.unionByName(rows.withColumn("grp", part).join(_sent(materialise(wide, "wide")), "grp", "left_semi"))
    return out.unionByName(rows.withColumn("grp", F.lit("*"))) if keys.filter("grp = '*'").head(1) else out


def _quantile_bins(rows: DataFrame, keys: list[str], bin_: str, share: float) -> DataFrame:
    """Per key the first bin at which the count reaches ``share`` of all rows; bins are few, whatever the rows."""
    hist = rows.groupBy(*keys, bin_).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumns({"cum": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return cum.filter(F.col("cum") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min(bin_).alias("at"))


def _medians(rows: DataFrame) -> DataFrame:
    """Median and scaled absolute deviation of each statistic per group, on bins of 1/128."""
    long = rows.select("grp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(F.col(c) * 128).alias("b")) for k, c in enumerate(STATISTICS)))).alias("v")).select("grp", "v.k", "v.b")
    median = materialise(_quantile_bins(long, ["grp", "k"], "b", 0.5).withColumnRenamed("at", "mid"), "medians")
    spread = _quantile_bins(long.join(_sent(median), ["grp", "k"]).withColumn("d", F.abs(F.col("b") - F.col("mid"))), ["grp", "k"], "d", 0.5)
    both = median.join(spread, ["grp", "k"]).withColumns({"mean": (F.col("mid") + 0.5) / 128, "sd": (F.col("at") + 0.5) / 128 * 1.4826})
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    floors = list(STATISTICS.values())
    est = both.groupBy("grp").agg(*(at("mean", k).alias(f"u{k}") for k in range(_D)), *(at("sd", k).alias(f"s{k}") for k in range(_D)))
    width = lambda i: F.greatest(F.col(f"s{i}"), F.lit(floors[i]))
    inverse = [(1 / width(i) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in _PAIRS]
    log_det = sum((2 * F.log(width(i)) for i in range(_D)), F.lit(0.0))
    return est.select("grp", *(f"u{k}" for k in range(_D)), *inverse, log_det.alias("log_det"))


def _moments() -> list[Column]:
    """Sums over a group: its rows, each statistic, each product of two."""
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"a{i}") for i in range(_D)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}{j}") for i, j in _PAIRS)]


_SUMS = ["n", *(f"a{i}" for i in range(_D)), *(f"a{i}{j}" for i, j in _PAIRS)]


def _estimate(rows: DataFrame, keys: list[str] = ("grp",)) -> DataFrame:
    """``_from_sums`` over ``rows``."""
    return _from_sums(rows.groupBy(*keys).agg(*_moments()), keys)


def _from_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, inverse Cholesky factor and log determinant of each group's covariance from its ``sums``; variances are at least
    the floors'."""
    moments = sums.select(*keys, *((F.col(f"a{i}") / F.col("n")).alias(f"u{i}") for i in range(_D)), *((F.col(f"a{i}{j}") / F.col("n")).alias(f"m{i}{j}") for i, j in _PAIRS))
    floors = list(STATISTICS.values())
    cov = {(i, j): (F.col(f"m{i}{j}") - F.col(f"u{i}") * F.col(f"u{j}")) * CONSISTENCY for i, j in _PAIRS}
    est = moments.withColumns({f"c{i}{j}": F.greatest(c, F.lit(floors[i] ** 2)) if i == j else c for (i, j), c in cov.items()})
    for i in range(_D):  # Cholesky, row by row; each entry is a column of its own so that expressions stay short
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(_D):  # inverse of the lower factor
        for j in range(i, -1, -1):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))
            est = est.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else -inner / F.col(f"l{i}{i}"))
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(_D)), F.lit(0.0))
    return est.select(*keys, *(f"u{i}" for i in range(_D)), *(f"w{i}{j}" for i, j in _PAIRS), log_det.alias("log_det"))


def _distance() -> Column:
    parts = [sum((F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"u{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(_D)]
    return sum((p * p for p in parts), F.lit(0.0))


def with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance ``d2`` (null where the row's group has no estimate)."""
    return rows.join(_sent(estimate), "grp", "left").select(*rows.columns, _distance().alias("d2"))


def _starts(rows: DataFrame) -> DataFrame:
    """``(grp, start)`` and the first estimate of each: 0 from medians, 1 from all rows, then from seeded parts."""
    number = lambda e, k: e.withColumn("start", F.lit(k))
    part = lambda k: rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(PART)) == 0)
    firsts = [number(_medians(rows), 0), number(_estimate(rows), 1), *(number(_estimate(part(k)), k) for k in range(2, 2 + PARTS))]
    return materialise(reduce(DataFrame.unionByName, firsts), "starts")


def _step(rows: DataFrame, starts: DataFrame, sent) -> DataFrame:
    """The estimates after one concentration step, from the ``SUPPORT`` share of rows of smallest distance, with the log
    determinants ``before`` it. ``sent`` wraps tables of one row a group and start."""
    keys = ["grp", "start"]
    level = F.log(F.col("d2") + 1e-6) * BINS
    far = rows.join(sent(starts), "grp").select("grp", "start", F.col("log_det").alias("before"), *STATISTICS, _distance().alias("d2"))
    far = far.withColumns({"bin": F.floor(level), "fine": F.floor((level - F.floor(level)) * FINE).cast("int")})
    keys.append("before")
    # bins hold the sums of their rows, so that only the rows of the bin at the edge are looked at again
    bins = materialise(far.groupBy(*keys, "bin").agg(*_moments()), "bins")
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = bins.withColumns({"cum": F.sum("n").over(up), "want": F.ceil(F.sum("n").over(Window.partitionBy(*keys)) * SUPPORT)})
    below = cum.filter("cum < want").select(*keys, *_SUMS)
    edge = cum.filter("cum >= want and cum - n < want").select(*keys[:2], F.col("bin").alias("at"), (F.col("want") - F.col("cum") + F.col("n")).alias("rest"))
    inner = far.join(sent(edge), keys[:2]).filter("bin = at").groupBy(*keys, "rest", "fine").agg(*_moments())
    within = Window.partitionBy(*keys).orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = inner.withColumn("cum", F.sum("n").over(within)).filter("cum - n < rest").select(*keys, *_SUMS)
    sums = below.unionByName(near).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))
    return materialise(_from_sums(sums, keys), "step")


def estimate(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per ``grp`` over ``rows`` with doc_id and the statistics' columns.

    Every start steps until its determinant falls no further; of the estimates after a step the one with the smallest
    determinant stays, on ties that of the earlier start.
    """
    starts = _starts(rows)
    few = starts.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    sent = lambda groups: F.broadcast(groups) if few else groups.hint("merge")
    live, stepped = starts.withColumn("log_det", F.lit(float("inf"))), []
    while len(stepped) < MOST_STEPS and live.head(1):
        step = _step(rows, live, sent)
        stepped.append(step.drop("before"))
        live = step.filter(F.col("log_det") < F.col("before") - SETTLED).drop("before")
    if unsettled := [r["grp"] for r in live.select("grp").distinct().limit(20).collect()]:
        warnings.warn(f"groups still moving after {MOST_STEPS} steps: {', '.join(unsettled)}", stacklevel=2)
    if not stepped:
        return starts.drop("start")
    best = reduce(DataFrame.unionByName, stepped).withColumn("_rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.round("log_det", 9), "start")))
    return materialise(best.filter("_rank = 1").drop("_rank", "start"), "estimate")


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Base counts, base_failed, kept and the squared distance ``d2`` of every row of ``docs``.

    Estimates use the documents that pass the base rules. Null lang or source is a group like any other; groups with
    few documents are held against the estimate of their whole language, or of all documents if that has few as well,
    and with fewer than ``MIN_GROUP`` documents in all nothing is rejected beyond the base rules. Repeated rows count as
    often as they occur, null and empty texts fail the base rules, very long texts are counted whole, and an empty table
    gives an empty result. Columns other than doc_id, text, lang and source are ignored, whatever their names.
    """
    rows = counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), ["doc_id", "lang", "source"])
    rows = materialise(rows.withColumns({**vector(), "base_failed": base_failed()}), "counts")
    passed = rows.filter(~F.col("base_failed")).select("doc_id", "lang", "source", *STATISTICS)
    keys = grouped(passed)
    members = materialise(placed(passed, keys), "placed")
    enough = members.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_GROUP).select("grp")
    est = estimate(members.join(_sent(materialise(enough, "enough")), "grp", "left_semi"))
    held = rows.join(_sent(keys.withColumnsRenamed({"lang": "l", "source": "s"})), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cutoff)
    return with_distance(held, est).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2")

