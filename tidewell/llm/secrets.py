"""Secrets by patterns and by a battery of randomness tests, in DataFrame operations only.

Candidates are long runs of key characters. Each gets an encoding (hex, base32 or base64 alphabet) and is turned into
symbol numbers, on which three tests of randomness are made: chi-squared uniformity over classes of symbols, runs about the
middle and lag-one serial correlation. Fisher's sum joins their p-values into one, ``q``: how likely a random string looks no
more random than this. Evidence against ordinary text is the likelihood ratio of the uniform alphabet to letters and digits as
prose has them; its inverse bounds the p-value of "ordinary text". A candidate's p-value is that bound divided by ``q``, so what
the battery finds unlike chance has to make up for it; both shrink with length. Benjamini-Hochberg over all candidates of
the corpus at ``RATE`` sets the p-value to reach, and again at ``CHANCE_RATE`` over the battery's ``q`` which candidates are
no random strings at all, however little they look like prose. Both read histograms with a fixed number of bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions import arrays
from tidewell.session import materialise

RATE, CHANCE_RATE = 1e-4, 1e-3
#: A run of key characters with the padding that may end it; a name and its value are apart, as "=" is no key character.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Histogram bins of -log2(p) and their number; p-values count as the upper end of their bin.
BINS_A_BIT, BINS = 4, 4096
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Letters of English prose per thousand, a to z: fixed values.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_SPAN = "struct<start: int, rank: int, end: int>"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """Every leftmost non-overlapping match as ``{start, end, value}``; start and end in code points.

    Splitting at the pattern gives the texts between the matches, so places follow from lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = lambda x: F.transform(x, lambda t: F.length(t))
    spans = arrays.placed(lengths(F.split(text, pattern, -1)), lengths(hits))
    found = F.zip_with(spans, value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    return F.when(F.col(text).rlike(pattern), found).otherwise(F.array().cast("array<struct<start: int, end: int, value: string>>"))


def _log_tail(z: Column) -> Column:
    """Natural logarithm of the upper tail of the normal distribution beyond ``z``, within about a hundredth."""
    upper = lambda x: -x * x / 2 - math.log(math.sqrt(2 * math.pi)) - F.log((1 - 1 / math.pi) * x + F.sqrt(x * x + 2 * math.pi) / math.pi)
    return F.when(z >= 0, upper(F.abs(z))).otherwise(F.log1p(-F.exp(upper(F.abs(z)))))


def log_randomness(x: Column, size: Column) -> Column:
    """Natural logarithm of the joint p-value of the three tests on the symbol numbers ``x`` (``0 .. size - 1``)."""
    n = F.size(x).cast("double")
    pairs = lambda v, f: F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), f)
    two_sided = lambda z: F.least(F.lit(0.0), math.log(2) + _log_tail(F.abs(z)))

    def uniform(c: Column) -> Column:
        classes = c["classes"]
        share = lambda k: (F.ceil((k + 1) * size / classes) - F.ceil(k * size / classes)) / size
        seen = lambda k: F.size(F.filter(c["of"], lambda s: s == k)).cast("double")
        chi = F.aggregate(F.sequence(F.lit(0), classes.cast("int") - 1), F.lit(0.0), lambda a, k: a + F.pow(seen(k) - n * share(k), F.lit(2.0)) / (n * share(k)))
        free = classes - 1
        return _log_tail((F.cbrt(chi / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))  # Wilson-Hilferty

    def runs(r: Column) -> Column:
        ones, zeros = r["ones"], n - r["ones"]
        expected = 2 * ones * zeros / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        return F.when((ones > 0) & (zeros > 0), two_sided((r["runs"] - expected) / spread)).otherwise((1 - n) * math.log(2))

    def serial(d: Column) -> Column:
        total = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v)
        lagged = F.aggregate(pairs(d, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, two_sided(lagged / total * F.sqrt(n))).otherwise((1 - n) * F.log(size))

    classes = F.greatest(F.lit(2.0), F.least(size, F.floor(n / 5).cast("double")))
    flat = arrays.let(classes, lambda m: arrays.let(F.struct(F.transform(x, lambda s: F.floor(s * m / size).cast("int")).alias("of"), m.alias("classes")), uniform))
    high = F.transform(x, lambda s: (s * 2 >= size).cast("int"))
    counted = lambda h: F.struct(F.aggregate(h, F.lit(0), lambda a, b: a + b).cast("double").alias("ones"), F.aggregate(pairs(h, lambda a, b: (a != b).cast("int")), F.lit(1), lambda a, b: a + b).alias("runs"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, s: a + s) / n
    total = flat + arrays.let(high, lambda h: arrays.let(counted(h), runs)) + arrays.let(mean, lambda m: arrays.let(F.transform(x, lambda s: s - m), serial))
    # Fisher: minus twice the sum is chi-squared with six degrees, whose tail has a closed form
    return arrays.let(-total, lambda t: F.log(1 + t + t * t / 2) - t)


def battery(value: Column) -> Column:
    """``{bits, randomness}`` of a candidate in bits: the evidence against ordinary text less what the tests of randomness
    speak against it, and the joint p-value of these tests. Without a letter and a digit there is no evidence."""
    prose = F.array(*(F.lit(math.log2(0.9 * p / 1000)) for p in LETTERS))
    code = lambda c: F.ascii(F.lower(c)) - 96
    natural = lambda c: (
        F.when(c.rlike("[a-z]"), F.element_at(prose, code(c))).when(c.rlike("[A-Z]"), F.element_at(prose, code(c)) - 5).when(c.rlike("[0-9]"), F.lit(math.log2(0.03 / 10))).otherwise(F.lit(math.log2(0.02)))
    )

    def judged(e: Column) -> Column:
        symbols = F.transform(e["chars"], lambda c: F.instr(e["alphabet"], c).cast("double") - 1)
        bits = F.aggregate(e["chars"], F.lit(0.0), lambda a, c: a - F.log2(e["size"]) - natural(c))
        tested = arrays.let(symbols, lambda x: log_randomness(x, e["size"])) / math.log(2)
        return arrays.let(tested, lambda q: F.struct(F.when(e["mixed"], bits + q).otherwise(0.0).alias("bits"), q.alias("randomness")))

    def encoded(kind: Column) -> Column:
        body = F.rtrim(F.translate(F.when(kind == "hex", F.lower(value)).otherwise(F.translate(value, "-_", "+/")), "=", " "))
        pick = lambda h, b, o: F.when(kind == "hex", h).when(kind == "base32", b).otherwise(o)
        return F.struct(
            F.filter(F.split(body, "", -1), lambda c: c != "").alias("chars"),
            pick(*(ALPHABETS[k] for k in ("hex", "base32", "base64"))).alias("alphabet"),
            pick(16.0, 32.0, 64.0).alias("size"),
            (value.rlike("[0-9]") & value.rlike("[A-Za-z]")).alias("mixed"),
        )

    kind = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(value.rlike("^[A-Z2-7]+=*$"), F.lit("base32")).otherwise(F.lit("base64"))
    return arrays.let(kind, lambda k: arrays.let(encoded(k), judged))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, assign, access, hex, random)`` of every row of ``docs``: arrays of ``{start, rank, end}``.

    Null texts are empty, very long ones are searched whole. random holds candidates that pass the false-discovery
    control and touch no base span. Repeated rows are rows of their own; no rows, no result. Columns other than doc_id and
    text are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", matches("text", ASSIGN, 2).alias("assign"), matches("text", ACCESS).alias("access"), matches("text", HEX).alias("hex"), matches("text", CANDIDATE).alias("runs"))
    plain = lambda name, rank, keep: F.transform(F.filter(name, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    tested = F.transform("runs", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["value"]).alias("b")))
    found = rows.select(
        "doc_id",
        plain("assign", 0, lambda m: F.length(m["value"]) >= 8).alias("assign"),
        plain("access", 1, lambda m: F.length(m["value"]) >= 16).alias("access"),
        plain("hex", 2, lambda m: F.length(m["value"]) >= 32).alias("hex"),
        tested.alias("runs"),
    )
    found = materialise(found, "secrets")
    need, unlike = threshold(found, F.col("m.b.bits"), RATE), threshold(found, -F.col("m.b.randomness"), CHANCE_RATE)
    base = F.concat("assign", "access", "hex")
    free = lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    random = F.transform(F.filter("runs", lambda m: (m["b"]["bits"] >= need) & (-m["b"]["randomness"] < unlike) & free(m)), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("rank"), m["end"].alias("end")))
    return found.select("doc_id", "assign", "access", "hex", random.alias("random"))


def threshold(found: DataFrame, evidence: Column, rate: float) -> float:
    """Bits of ``evidence`` of a candidate ``m`` that the false-discovery control asks for: the lowest bin whose p-value meets
    the Benjamini-Hochberg line among all candidates; infinite if none does."""
    bits = found.select(F.explode("runs").alias("m")).select(F.least(F.greatest(F.floor(evidence * BINS_A_BIT), F.lit(0)), F.lit(BINS)).alias("bin"))
    hist = bits.groupBy("bin").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("bin").desc())
    line = hist.withColumns({"at_least": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy())})
    met = line.filter((F.col("bin") > 0) & (F.pow(F.lit(2.0), -F.col("bin") / BINS_A_BIT) <= rate * F.col("at_least") / F.col("all")))
    lowest = met.agg(F.min("bin")).first()[0]
    return math.inf if lowest is None else lowest / BINS_A_BIT


def _joined(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    base = F.concat("assign", "access", "hex")
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.concat(base, "random")).alias("spans"), size("random").alias("n_random")
    )
