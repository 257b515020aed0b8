"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.session import materialise


def _with_minimum(edges: DataFrame, at: str, other: str) -> DataFrame:
    """``edges`` with the smallest neighbour of ``at`` (itself included) as ``low``.

    The minimum is pre-aggregated and joined back, so a hub's neighbours are never gathered in one task:
    the join may be split by adaptive execution.
    """
    low = edges.groupBy(at).agg(F.least(F.min(other), F.col(at)).alias("low"))
    return edges.join(low, at)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for every node that occurs in ``links``; component is the smallest node reachable.

    Null ends and self-links are ignored, repeated links count once; no links give an empty table.
    Every round is written to the shared folder. Rounds stop when the edge set no longer changes; as a round's
    output depends only on its input, equal counts and hash sums mean a fixed point.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges = materialise(edges, "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()
        low = _with_minimum(large, "u", "v")
        small = low.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        edges = materialise(small, "edges")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
