"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root): each node of an edge with the smallest node that it reaches.

    Alternates large-star and small-star steps until the edges are stars. Each step is written to the shared
    folder, so its lineage is short; both steps keep the number of edges bounded by that of the input. A node
    of many edges is grouped by partial minima first and its edges are joined by node, where Spark splits
    skewed sides.
    """
    now = materialize(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: neighbours above a node move to its least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        large = materialize(large, "large-star")
        # small-star: a node and its smaller neighbours move to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v").select("u", "v", "m")
        small = moved.select(F.col("m").alias("x"), F.col("v").alias("y")).union(moved.select("m", "u")).where("x <> y").distinct()
        after = materialize(small.select(F.col("x").alias("u"), F.col("y").alias("v")), "small-star")
        changed = after.join(now, ["u", "v"], "left_anti").limit(1).count() + now.join(after, ["u", "v"], "left_anti").limit(1).count()
        now = after
        if not changed:
            break
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.union(now.select("u", "u").distinct())
