"""Connected components of a graph given by its edges, by joins and grouped aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge; the component is its smallest node.

    Large-star and small-star steps alternate until the edges no longer change: each points nodes to
    the smallest neighbour known, so that every component ends as a star around its smallest node.
    Steps are written to the shared folder. A node of very many edges is only ever aggregated with
    partial sums or joined on, never gathered. Null ends and loops are ignored.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    rows = 2 * now.count()  # no step makes more
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u gets the smallest node around u
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large", rows)
        # small star: the smaller neighbours of u, and u itself, get the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(small, "edges", rows)
        # stars only: no node is both a centre and around another
        if not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
