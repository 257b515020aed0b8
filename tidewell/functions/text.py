"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewell.functions import arrays

_HANDLE = r"(?u)@[\p{L}\p{N}_]+"
#: Typed placeholders of redaction: fixed values.
PLACEHOLDERS = {
    "email": "[REDACTED_EMAIL]",
    "iban": "[REDACTED_IBAN]",
    "card": "[REDACTED_CREDIT_CARD]",
    "ip": "[REDACTED_IP]",
    "phone": "[REDACTED_PHONE]",
}
REDACTED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "ip": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b",
}


def _host(piece: Column) -> Column:
    """The host that ``piece`` ends with: two labels or more of letters, digits and hyphens; empty if it ends with none."""
    tail = F.substring_index(F.regexp_extract(piece, "[A-Za-z0-9.-]*$", 0), "..", -1)
    tail = F.when(tail.startswith("."), F.substring(tail, 2, 1 << 20)).otherwise(tail)
    return F.when(tail.endswith(".") | ~tail.contains("."), F.lit("")).otherwise(tail)


def _before_link(part: Column) -> Column:
    """What stands in ``part`` (which has no white space) before a link begins, or all of it.

    A link begins at a scheme, at ``www.``, or at a host that a slash follows.
    """

    def of(pieces: Column) -> Column:
        hosts = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _host)
        first = F.array_position(F.transform(hosts, lambda h: h != ""), F.lit(True))
        before = F.array_join(F.slice(pieces, F.lit(1), first.cast("int")), "/")
        return F.when(first > 0, F.length(before) - F.length(F.get(hosts, (first - 1).cast("int"))))

    low = F.lower(part)
    starts = [F.when(F.instr(low, mark) > 0, F.instr(low, mark) - 1) for mark in ("http://", "https://", "www.")]
    at = F.least(*starts, arrays.let(F.split(part, "/", -1), of))
    return F.when(at.isNull(), part).otherwise(F.substring(part, F.lit(1), at.cast("int")))


def strip_noise(text: Column) -> Column:
    """Without links, @handles and hash marks; white space collapsed. Null gives the empty string."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    linked = F.transform(parts, lambda p: F.when(p.contains("/") | F.lower(p).contains("www."), _before_link(p)).otherwise(p))
    words = F.translate(F.regexp_replace(F.array_join(linked, " "), _HANDLE, " "), "#", " ")
    return F.trim(F.regexp_replace(words, " +", " "))


def alpha_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def language_gate(text: Column, min_len: int = 24, min_alpha: int = 8) -> Column:
    """Whether stripped text is long enough for a language detector."""
    t = strip_noise(text)
    return (F.length(t) >= min_len) & (alpha_count(t) >= min_alpha)


def truncate(text: Column, limit: int = 4000) -> Column:
    """Carriage returns become spaces, ends are trimmed, longer text is cut with an ellipsis; null stays null."""
    t = F.trim(F.translate(text, "\r", " "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def redact(text: Column) -> Column:
    """Personal data replaced by typed placeholders, most specific kinds first; null gives the empty string."""
    out = F.coalesce(text, F.lit(""))
    for kind, pattern in REDACTED.items():
        out = F.regexp_replace(out, pattern, PLACEHOLDERS[kind])
    return out


def normal_channel(name: Column) -> Column:
    """A channel's bare name from a link or a handle."""
    s = F.regexp_replace(F.trim(name), "https?://", "")
    s = F.replace(F.replace(s, F.lit("t.me/s/"), F.lit("")), F.lit("t.me/"), F.lit(""))
    return F.regexp_replace(s, "^@", "")


def normal_term(name: Column) -> Column:
    """Lower case without apostrophes of either form."""
    return F.translate(F.lower(name), "'’", "")


def usable(text: Column) -> Column:
    """Text that says something: neither blank nor a removal notice."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ~t.isin("", "[removed]", "[deleted]", "[redacted]")


def submission_text(title: Column, body: Column, is_self: Column) -> Column:
    """The title, with the body below it for self posts whose body is usable."""
    return F.when(F.coalesce(is_self, F.lit(False)) & usable(body), F.concat_ws("\n", title, body)).otherwise(title)


def spans(text: Column, term: Column) -> Column:
    """Case-insensitive literal occurrences of ``term`` as ``{start, end}`` in code points, non-overlapping.

    Native: the text is split at the quoted term, so places follow from the lengths of the parts. An empty term has
    no occurrence; null text or term gives null.
    """
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    gaps = F.transform(F.split(text, quoted, -1), lambda p: F.length(p))
    empty = F.array().cast("array<struct<start: int, end: int>>")
    found = arrays.let(gaps, lambda g: F.when(F.size(g) > 1, arrays.placed(g, F.array_repeat(F.length(term), F.size(g) - 1))).otherwise(empty))
    return F.when(text.isNull() | term.isNull(), F.lit(None)).when(F.length(term) == 0, empty).otherwise(found)


def exceeds_any(scores: Column, thresholds: dict[str, float]) -> Column:
    """Whether any label's score in the map ``scores`` reaches its threshold; an empty or null map never does."""
    tests = [F.coalesce(scores[label] >= limit, F.lit(False)) for label, limit in thresholds.items()]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out
