"""Many literal terms found in one pass over each text, whatever their case: an Aho-Corasick automaton over batches.

Terms go to the executors in parts of bounded size; a worker builds a part's automaton once and runs it over all texts
it is given. Posts are not shuffled.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.session import ship

#: Characters of the names of one part of the terms.
PART_CHARS = 500_000
#: Hits that are passed on together.
_HITS = 1 << 17


@cache
def _unusual() -> dict[int, str]:
    """Lower-case letters that match others when case is ignored, by letter: those that upper case maps elsewhere."""
    found = {}
    for code in range(0x80, 0x20000):
        low = chr(code).lower()
        if len(low) != 1:
            continue
        up = low.upper()
        back = up.lower() if len(up) == 1 else low
        if back != low and len(back) == 1:
            found[ord(low)] = back
    return found


def folded(text: str) -> str:
    """``text`` in lower case, letter by letter: as long as it was, and equal for texts that differ in case only."""
    if text.isascii():
        return text.lower()
    return text.replace("İ", "i").lower().translate(_unusual())


def parts(terms: DataFrame, limit: int | None = None) -> Iterator[list[tuple]]:
    """``(term_id, name)`` of all terms with a name, in parts of about ``limit`` characters (``PART_CHARS``) each."""
    limit = limit or PART_CHARS
    named = terms.select("term_id", "name").filter("name <> ''")
    size = named.agg(F.sum(F.length("name") + 1)).first()[0]
    n = -(-size // limit) if size else 0
    for k in range(n):
        own = named if n == 1 else named.filter(F.pmod(F.xxhash64("term_id", "name"), F.lit(n)) == k)
        if part := [tuple(r) for r in own.collect()]:
            yield part


_built: OrderedDict[str, object] = OrderedDict()


def _automaton(key: str, part: list[tuple]):
    """The automaton of a part, built once in each worker under ``key``; the last few are kept."""
    import ahocorasick

    if key not in _built:
        names: dict[str, list[int]] = {}
        for k, (_, name) in enumerate(part):
            names.setdefault(folded(name), []).append(k)
        machine = ahocorasick.Automaton()
        for name, own in names.items():
            machine.add_word(name, (len(name), tuple(own)))
        machine.make_automaton()
        _built[key] = machine
        while len(_built) > 2:
            _built.popitem(last=False)
    return _built[key]


def spans_of(machine, text: str) -> list[tuple[int, int, int]]:
    """``(term, start, end)`` of the occurrences in ``text``: those of one term do not overlap, leftmost first."""
    out, last = [], {}
    for at, (length, own) in machine.iter(folded(text)):
        start = at + 1 - length
        if start >= last.get(own, 0):
            last[own] = at + 1
            for k in own:
                out.append((k, start, at + 1))
    return out


def span_hits(posts: DataFrame, terms: DataFrame, key: str = "post_id", body: str = "text") -> DataFrame:
    """``(key, term_id, match_start, match_end)`` of every literal occurrence of a term's name, in code points.

    Case is ignored letter by letter. Occurrences of different terms may overlap, those of one do not. Null texts and
    empty or null names have none; rows and terms that are repeated have theirs again.
    """
    spark = posts.sparkSession
    ship(spark)
    rows = posts.select(F.col(key), F.col(body).cast("string").alias("_body")).filter("_body <> ''")
    schema = posts.select(key).schema.add(terms.schema["term_id"]).add("match_start", T.IntegerType()).add("match_end", T.IntegerType())
    found = [_hits_of(rows, part, schema) for part in parts(terms)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _hits_of(rows: DataFrame, part: list[tuple], schema) -> DataFrame:
    name, shared = uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(part)
    id_type = to_arrow_type(schema[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids = _automaton(name, shared.value), pa.array([t for t, _ in shared.value], id_type)
        for batch in batches:
            at, found, last = [], [], batch.num_rows - 1
            for k, text in enumerate(batch.column(1)):
                own = spans_of(machine, text.as_py())
                at += [k] * len(own)
                found += own
                if found and (len(found) >= _HITS or k == last):
                    which, starts, ends = (pa.array(np.array(x, np.int32)) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.take(which), starts, ends], schema.names)
                    at, found = [], []

    return rows.mapInArrow(run, schema)
