"""Keyset cursors over a Parquet folder as a data source: ordered pages in batches, and a stream with (ts, id) offsets.

Registered as ``keyset``. Options: ``path`` (a folder that driver and executors see), ``order`` (the key's columns, from
the most significant one, none of them null), ``page`` (rows that are passed on at a time), ``rows`` (of a range of keys,
about), ``after`` (a JSON list: the key to start behind) and, for streams, ``from`` ("earliest" or "latest").

As a batch, partitions are ranges of keys in ascending order and each gives its rows in order, so rows come in
the order of the key throughout and no one sorts the whole. As a stream, an offset is the key of the last row that was read: a
batch holds the rows behind the last offset up to the largest key there is. A restart goes on behind the offset
of its checkpoint, so no row comes twice and none is left out; rows that arrive later with a key at or below an
offset count as seen, which is what a cursor of this kind means.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, datetime, timezone
from functools import reduce
from typing import Any
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tidewell.session import ship

PAGE, ROWS = 2000, 200_000
_ORIGIN = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _plain(value: Any) -> Any:
    """A key's value as JSON holds it: times as microseconds, days as their number."""
    if isinstance(value, datetime):
        delta = (value if value.tzinfo else value.replace(tzinfo=timezone.utc)) - _ORIGIN
        return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    return (value - _ORIGIN.date()).days if isinstance(value, date) else value


def _scalar(value: Any, kind: pa.DataType) -> pa.Scalar:
    """The inverse of ``_plain`` in a column's own type."""
    if pa.types.is_timestamp(kind):
        return pa.scalar(value, pa.timestamp("us", kind.tz)).cast(kind)
    return pa.scalar(value, pa.int32()).cast(kind) if pa.types.is_date(kind) else pa.scalar(value, kind)


class Keyset:
    """The folder and the order of its rows."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.path, self.order = self.options["path"], [c.strip() for c in self.options["order"].split(",")]
        self.page, self.rows = int(self.options.get("page", PAGE)), int(self.options.get("rows", ROWS))

    def dataset(self) -> ds.Dataset:
        """What the folder holds now; files whose names begin with a dot or an underscore are not read."""
        parsed = urlparse(self.path)
        if parsed.scheme in ("", "file"):
            return ds.dataset(unquote(parsed.path) if parsed.scheme else self.path, format="parquet")
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        return ds.dataset(path, format="parquet", filesystem=store)

    def behind(self, data: ds.Dataset, key: list) -> ds.Expression:
        """Rows with a larger key; the first test alone lets files and row groups be left out by their statistics."""
        values = [_scalar(v, data.schema.field(c).type) for c, v in zip(self.order, key)]
        tests = [reduce(lambda a, b: a & b, [ds.field(c) == v for c, v in zip(self.order[:k], values)], ds.field(self.order[k]) > values[k]) for k in range(len(values))]
        return (ds.field(self.order[0]) >= values[0]) & reduce(lambda a, b: a | b, tests)

    def largest(self, data: ds.Dataset, where: ds.Expression | None = None) -> list | None:
        """The largest key, column by column: each scan reads a key's column where those before it are largest."""
        key: list = []
        for name in self.order:
            most = None
            for batch in data.to_batches(columns=[name], filter=where):
                own = pc.max(batch.column(0))
                most = own if own.is_valid and (most is None or own.as_py() > most.as_py()) else most
            if most is None:
                return None
            key.append(_plain(most.as_py()))
            test = ds.field(name) == most
            where = test if where is None else where & test
        return key

    def cuts(self, data: ds.Dataset, after: list | None, end: list | None) -> list:
        """Values of the key's first column that part the rows between ``after`` and ``end`` into ranges of ``rows``.

        Only the largest values and the sizes of row groups are looked at, so ranges are as fine as these are apart, and a
        column without statistics gives a single range.
        """
        first, groups = self.order[0], []
        for fragment in data.get_fragments():
            for group in fragment.row_groups:
                try:
                    most = _plain(((group.statistics or {}).get(first) or {}).get("max"))
                except pa.ArrowNotImplementedError:  # times of twelve bytes have no statistics
                    return []
                if most is not None and (after is None or most >= after[0]):
                    groups.append((most, group.num_rows))
        out, held = [], 0
        for most, n in sorted(groups):
            held += n
            if held >= self.rows and (end is None or most < end[0]):
                out.append(most)
                held = 0
        return sorted(set(out))

    def ranges(self, after: list | None, end: list | None) -> list[Range]:
        """Ranges in ascending order, the first behind ``after``, the last up to and with ``end``."""
        cuts = self.cuts(self.dataset(), after, end)
        return [Range(after, low, high, end) for low, high in zip([None, *cuts], [*cuts, None])]

    def read(self, part: Range, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The rows of a range in order, ``page`` at a time."""
        data = self.dataset()
        name = self.order[0]
        first = lambda v: _scalar(v, data.schema.field(name).type)
        tests = []
        if part.after is not None:
            tests.append(self.behind(data, part.after))
        if part.end is not None:
            tests.append((ds.field(name) <= first(part.end[0])) & ~self.behind(data, part.end))
        if part.low is not None:
            tests.append(ds.field(name) > first(part.low))
        if part.high is not None:
            tests.append(ds.field(name) <= first(part.high))
        columns = list(dict.fromkeys([*schema.names, *self.order]))
        found = data.to_table(columns=columns, filter=reduce(lambda a, b: a & b, tests) if tests else None)
        found = found.sort_by([(c, "ascending") for c in self.order]).select(schema.names)
        yield from found.cast(schema).combine_chunks().to_batches(max_chunksize=self.page)


class Range(InputPartition):
    """Keys behind ``after`` up to and with ``end``, of these with a first column above ``low`` up to ``high``."""

    def __init__(self, after: list | None, low: Any, high: Any, end: list | None) -> None:
        self.after, self.low, self.high, self.end = after, low, high, end


class KeysetReader(DataSourceReader):
    def __init__(self, keys: Keyset, schema) -> None:
        self.keys, self.schema = keys, to_arrow_schema(schema)

    def partitions(self) -> list[Range]:
        after = self.keys.options.get("after")
        return self.keys.ranges(json.loads(after) if after else None, None)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.keys.read(partition, self.schema)


class KeysetStreamReader(DataSourceStreamReader):
    def __init__(self, keys: Keyset, schema) -> None:
        self.keys, self.schema = keys, to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        after = self.keys.options.get("after")
        if self.keys.options.get("from", "earliest") == "latest":
            return {"key": self.keys.largest(self.keys.dataset())}
        return {"key": json.loads(after) if after else None}

    def latestOffset(self) -> dict:
        return {"key": self.keys.largest(self.keys.dataset())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [] if end["key"] is None or start["key"] == end["key"] else self.keys.ranges(start["key"], end["key"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.keys.read(partition, self.schema)


class KeysetSource(DataSource):
    """``spark.read.format("keyset")`` and ``spark.readStream.format("keyset")``."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self):
        return from_arrow_schema(Keyset(dict(self.options)).dataset().schema, prefer_timestamp_ntz=False)

    def reader(self, schema) -> KeysetReader:
        return KeysetReader(Keyset(dict(self.options)), schema)

    def streamReader(self, schema) -> KeysetStreamReader:
        return KeysetStreamReader(Keyset(dict(self.options)), schema)


def register(spark: SparkSession) -> None:
    """Make the format ``keyset`` known to the session."""
    ship(spark)
    spark.dataSource.register(KeysetSource)
