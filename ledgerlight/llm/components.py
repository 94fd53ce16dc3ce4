"""Connected components of an undirected graph that may have hubs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _only_stars(edges: DataFrame) -> bool:
    """Does every edge lead from a node with this edge only to one that no edge leads from?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return ends.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``label`` for each end of an edge ``a``, ``b``; the label is the smallest id of the component.

    A large star links the larger neighbours of a node to its smallest neighbour, a small star the smaller ones; rounds
    are about logarithmic in the size of a component. Each round's edges are written to the shared folder, so a lost
    executor costs one round at most. Minima combine before the shuffle, and the joins that hand them back can be
    split, so a hub isn't one task's work. Edges with a null end or with equal ends are left out.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    while not _only_stars(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = materialise(both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(rest.union(least.select("u", "m")).distinct(), "edges")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.union(stars.select(F.col("label").alias("id"), "label").distinct())
