"""Array helpers as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside lambdas an expression is evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _appended(start: Column, values: Column) -> Column:
    """``start`` plus the running sums of a short array."""
    empty = F.array().cast("array<bigint>")
    step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out"))
    return F.aggregate(values, F.struct(start.alias("at"), empty.alias("out")), step, lambda s: s["out"])


def running_sums(values: Column) -> Column:
    """Running sums (bigint) of an integer array; empty for an empty one.

    A fold that appends to an array copies it at every step, so sums are appended within blocks of 64 only, and block
    totals in the same way.
    """
    zero = F.lit(0).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda a, v: a + v)

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.concat(F.array(zero), _appended(zero, F.transform(bs, total))), lambda x, at: F.when(x.isNotNull(), _appended(at, x)).otherwise(F.array().cast("array<bigint>")))))

    return F.when(F.size(values) > 0, let(F.transform(values, lambda v: v.cast("long")), of)).otherwise(F.array().cast("array<bigint>"))


def placed(gaps: Column, sizes: Column) -> Column:
    """``array<{start, end}>`` of pieces of ``sizes`` that ``gaps`` (one for each, more are ignored) stand before."""
    both = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), lambda x: x["size"].isNotNull())
    ends = lambda zipped: running_sums(F.transform(zipped, lambda x: x["gap"] + x["size"]))
    span = lambda x, end: F.struct((end - x["size"]).cast("int").alias("start"), end.cast("int").alias("end"))
    return let(both, lambda zipped: F.zip_with(zipped, ends(zipped), span))
