"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans.lineage import written

MAX_ROUNDS = 60


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs under one root that hangs under none."""
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.join(roots, "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """``id`` and ``component`` (its smallest member) of each node of ``edges``; with ``nodes`` (one column), singletons too.

    Large-star / small-star: every round hangs neighbours under smaller ones, until
    the edges are stars. A round is two aggregations and two joins, never a
    collected neighbour list, and is written out, so lineage stays short.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = written(e)
    for _ in range(MAX_ROUNDS):
        if _stars(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u")
        e = written(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = out.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return out
    n = nodes.select(F.col(nodes.columns[0]).alias("id")).distinct()
    return n.join(out, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
