"""Connected components of an edge list by alternating large-star and small-star rounds.

Each round is two joins on aggregated minima; no neighbour list is ever gathered, so one vertex with
most of the edges is only a skewed join key.  Every round is cut by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import checkpoint


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star round over (u, v) with u > v.

    Large star: every larger neighbour of a vertex is hung on the vertex's least neighbour.
    Small star: every smaller neighbour, and the vertex itself, is hung on it.
    """
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges if small else edges.unionByName(flipped)
    least = around.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    linked = around.join(least, "u")
    if small:
        out = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
    else:
        # The vertex itself keeps its link to its least neighbour: it is a larger neighbour of that one.
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root): each linked id and the least id it reaches."""
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links = checkpoint(links)
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
        links = checkpoint(_stars(_stars(links, small=False), small=True))
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
