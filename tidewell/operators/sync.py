"""A kept registry that follows its sources, inserts and deletes alike, by comparing trees of digests.

Keys fall into ``2 ** BITS`` leaves by their hash. A leaf's digest is the number of its keys and the sum of a second
hash; a node's is the sum of its children's. The registry keeps its tree, so a run scans the sources' keys once for
theirs, compares the two from the root down along differing nodes only, and reads rows of both sides only where leaves
differ. The registry is stored by parts (runs of leaves), each sorted by leaf; a run rewrites the parts that it changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.functions import keys
from tidewell.session import materialise, numbered

#: Leaves are numbered by so many bits, the registry's parts by so many, and each level of the tree has so many more.
BITS, PART_BITS, STEP = 16, 8, 4

KEY = ("platform", "key1", "key2")
_ROW = "id long, platform string, key1 string, key2 string, leaf int"
_TREE = "leaf int, n long, digest decimal(38, 0)"


def leaf_of(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*KEY), 64 - bits).cast("int")


def leaves(rows: DataFrame) -> DataFrame:
    """``(leaf, n, digest)`` of rows that have their leaf; sums within tasks come first, so a leaf is never gathered."""
    own = F.xxhash64(F.lit("digest"), *KEY).cast("decimal(38, 0)")
    return rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(own).cast("decimal(38, 0)").alias("digest"))


def differing(a: DataFrame, b: DataFrame, bits: int, step: int = STEP) -> list[int]:
    """The leaves whose digests differ, found from the root down: of each level only children of differing nodes are compared.

    ``a`` and ``b`` have a row for each leaf that is not empty, so their size and the result's are bounded by ``2 ** bits``.
    """
    sides = [materialise(x.select("leaf", "n", "digest"), "leaves") for x in (a, b)]
    found: list[int] = [0]
    depths = [*range(step, bits, step), bits]
    for above, depth in zip([0, *depths[:-1]], depths):
        node = F.shiftright("leaf", bits - depth)
        inside = F.shiftright("leaf", bits - above).isin(found)
        one, other = (x.filter(inside).groupBy(node.alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest")) for x in sides)
        same = one.alias("a").join(other.alias("b"), "node", "full")
        odd = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest")))
        found = [r["node"] for r in same.filter(odd).select("node").collect()]
        if not found:
            return []
    return sorted(found)


class Kept:
    """The registry below ``path``: ``rows`` by part, ``tree`` by part, and ``top``, the largest id ever given."""

    def __init__(self, spark: SparkSession, path: str, bits: int = BITS, part_bits: int = PART_BITS) -> None:
        self.spark, self.path, self.bits, self.part_bits = spark, path.rstrip("/"), bits, min(part_bits, bits)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:  # rows without a leaf are the marks of parts that became empty
            return self.spark.read.schema(f"{schema}, part int").parquet(f"{self.path}/{name}").filter("leaf IS NOT NULL")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{schema}, part int")

    def _part(self) -> Column:
        return F.shiftright("leaf", self.bits - self.part_bits)

    def rows(self) -> DataFrame:
        """``(id, platform, key1, key2, post_key)`` of all that is registered."""
        return self._read("rows", _ROW).select("id", *KEY, keys.post_key(*(F.col(c) for c in KEY)).alias("post_key"))

    def top(self) -> int:
        try:
            return self.spark.read.schema("top long").parquet(f"{self.path}/top").agg(F.max("top")).first()[0] or 0
        except AnalysisException:
            return 0

    def sync(self, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Make the registry hold the keys of ``sources`` and no others: ``(inserted, deleted)`` rows with their ids.

        New ids go on after the largest ever given, in the order of the keys; keys that stay keep theirs. Keys with a null
        part never register, repeated keys do once. A run that fails leaves some parts old; the next one mends them.
        """
        bits = self.bits
        own = sources.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in KEY))).select(*KEY).withColumn("leaf", leaf_of(bits))
        # of a key's copies one counts: keys are made distinct where their leaf is summed up
        changed = differing(leaves(own.dropDuplicates([*KEY])), self._read("tree", _TREE), bits)
        empty = self.spark.createDataFrame([], "id long, platform string, key1 string, key2 string")
        if not changed:
            return empty, empty
        parts = sorted({leaf >> bits - self.part_bits for leaf in changed})
        here = F.col("leaf").isin(changed)
        old = self._read("rows", _ROW).filter(F.col("part").isin(parts))
        now = own.filter(here).dropDuplicates([*KEY])
        deleted = materialise(old.filter(here).join(now, [*KEY], "left_anti").select("id", *KEY), "deleted")
        fresh = materialise(now.join(old.filter(here), [*KEY], "left_anti").select(*KEY, "leaf"), "fresh")
        top = self.top()
        inserted = materialise(numbered(fresh, [*KEY], "id", top).select("id", *KEY, "leaf"), "inserted")
        new_top = inserted.agg(F.max("id")).first()[0] or top
        # ids are spoken for before any row has them, so that they are never given twice
        self.spark.createDataFrame([(new_top,)], "top long").coalesce(1).write.mode("append").parquet(f"{self.path}/top")
        kept = old.join(deleted, "id", "left_anti").select("id", *KEY, "leaf").unionByName(inserted)
        kept = materialise(kept.withColumn("part", self._part()), "registry")
        self._overwrite(kept.repartition("part").sortWithinPartitions("part", "leaf"), "rows", parts)
        tree = self._read("tree", _TREE).filter(F.col("part").isin(parts) & ~here).select("leaf", "n", "digest").unionByName(leaves(kept.filter(here)))
        self._overwrite(materialise(tree.withColumn("part", self._part()), "tree").coalesce(1), "tree", parts)
        return inserted.select("id", *KEY), deleted

    def _overwrite(self, rows: DataFrame, name: str, parts: list[int]) -> None:
        """Replace the named parts; those that have no rows any more get an empty mark instead."""
        kind = rows.schema
        gone = self.spark.createDataFrame([(p,) for p in parts], "part int").join(rows.select("part").distinct(), "part", "left_anti")
        mark = gone.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "part" else F.col("part") for f in kind))
        rows.unionByName(mark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/{name}")
