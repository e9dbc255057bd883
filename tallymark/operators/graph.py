"""Closures over parent links: lineage of records, ancestors and descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import keep


def closure(links: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """Every (key, node, depth) that ``starts`` (key, node) reach over ``links`` (parent, child), the starts themselves left out unless a cycle leads back.

    ``depth`` is the least number of links; a node met before is not walked again, so cycles end.  Depths are followed to the end, or up to ``most``.
    """
    links = keep(links.select("parent", F.col("child").alias("next")).where("parent IS NOT NULL AND child IS NOT NULL").distinct(), "closure-links")
    frontier, seen, depth = starts.select("key", "node").distinct(), None, 0
    while True:
        depth += 1
        met = frontier.join(links, F.col("node") == F.col("parent")).select("key", F.col("next").alias("node")).distinct()
        if seen is not None:
            met = met.join(seen.select("key", "node"), ["key", "node"], "left_anti")
        frontier = keep(met.withColumn("depth", F.lit(depth)), "closure-frontier")
        if seen is not None and frontier.isEmpty():
            return seen
        seen = frontier if seen is None else seen.unionByName(frontier)
        if depth == most:
            return seen


def ancestors(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The (key, node, depth) that lead to ``starts`` (key, node)."""
    return closure(links.select(F.col("child").alias("parent"), F.col("parent").alias("child")), starts)


def descendants(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(parent, child) links -> every (ancestor, node) and its least depth, in as many rounds as the longest path has links, or ``max_depth``."""
    starts = edges.select(F.col("parent").alias("key"), F.col("parent").alias("node"))
    return closure(edges, starts, max_depth).select(F.col("key").alias("ancestor"), "node", "depth")


def degree(edges: DataFrame) -> DataFrame:
    """Links into and out of every node."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("parent").alias("node"), F.lit(1).alias("out_links"), F.lit(0).alias("in_links")), F.struct(F.col("child").alias("node"), F.lit(0).alias("out_links"), F.lit(1).alias("in_links")))))
    return ends.groupBy("node").agg(F.sum("out_links").alias("out_links"), F.sum("in_links").alias("in_links"))


def edge_scores(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predicted links against true ones, directions ignored."""
    bare = lambda t, name: t.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b")).distinct().withColumn(name, F.lit(1))
    joined = bare(predicted, "p").join(bare(true, "t"), ["a", "b"], "full_outer")
    hit, p, t = F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()), F.count("p"), F.count("t")
    return joined.agg(hit.alias("n_hit"), F.round(F.try_divide(hit, p), 6).alias("precision"), F.round(F.try_divide(hit, t), 6).alias("recall"), F.round(F.try_divide(2 * hit, p + t), 6).alias("f1"))
