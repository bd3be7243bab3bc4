"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stored

#: Edges up to whose number the least neighbours go to all executors.
FEW_EDGES = 100_000


def _large_star(edges: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(side(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(side(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that an edge touches and that isn't its root.

    edges: columns u, v of any one orderable type of a few bytes; the root is the component's
    smallest node. Each round is two aggregations and two joins over the edges that
    are left, written to the shared folder; rounds grow with the logarithm of the
    longest chain. Null ends and loops are left out.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now, before = stored(now.distinct(), "edges"), None
    for _ in range(rounds):
        mark = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        side = F.broadcast if mark["n"] <= FEW_EDGES else shuffled
        now = stored(_small_star(_large_star(now, side), side), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
