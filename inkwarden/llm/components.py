"""Connected components by alternating large and small stars, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _done(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no end of one begins another, and each vertex has one end."""
    if not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def components(edges: DataFrame, name: str = "stars", most: int = 60) -> DataFrame:
    """(v, comp) for each vertex of `edges` (a, b) except those that are their component's smallest id.

    Each round writes its edges to the shared folder; the driver sees only whether they are stars yet. A hub's neighbours are
    combined map-side, and the joins that bring a hub's minimum to its neighbours split hot hubs under adaptive execution.
    """
    e = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0", narrow=True)
    for k in range(1, most):
        if _done(e):
            return e.select(F.col("u").alias("v"), F.col("v").alias("comp"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, f"{name}-large-{k}", narrow=True)
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}", narrow=True)
    raise RuntimeError(f"components did not settle in {most} rounds")
