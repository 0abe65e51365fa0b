"""Connected components of a graph of links, without hot keys and without the driver.

Every node points to its smallest neighbour; a node with several smaller
neighbours passes the others on as links to the smallest one. Links are grouped
by their larger end only, so the centre of a star never gathers its leaves.
When each node has one parent left, parents are followed by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lorewell.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node that has a smaller one in its component.

    ``links`` has columns a, b (long, not null); direction and repeats don't matter.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = materialize(edges, "links")
    forest = None
    while True:
        parent = edges.groupBy("hi").agg(F.min("lo").alias("parent"), F.count(F.lit(1)).alias("n"))
        several = materialize(parent.where("n > 1").select("hi", "parent"), "parents")
        if several.isEmpty():
            break
        passed = edges.join(several, "hi").where("lo <> parent").select(F.col("lo").alias("hi"), F.col("parent").alias("lo"))
        straight = parent.select("hi", F.col("parent").alias("lo"))
        edges = materialize(straight.unionByName(passed).distinct(), "links")
    forest = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    while True:
        # only parents that have a parent themselves need a step; a star's centre has none
        steps = forest.select(F.col("root").alias("mid")).distinct().join(forest.select(F.col("node").alias("mid"), F.col("root").alias("next")), "mid")
        steps = materialize(steps, "steps")
        if steps.isEmpty():
            return forest
        forest = materialize(
            forest.join(steps, forest["root"] == steps["mid"], "left").select("node", F.coalesce("next", "root").alias("root")), "forest"
        )
