"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelmark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the root is the smallest node that links reach.

    Each round hooks every node to its smallest neighbour and puts these in the place of the nodes, which
    at least halves the nodes that still have links. All rounds are joins and minima, with hubs summed up
    before any shuffle; tables are written to the shared folder, so a lost executor costs one round.
    """
    found = links.select("a", "b").filter("a <> b")
    both = found.union(found.select("b", "a"))
    labels = materialize(both.select("a").union(both.select("b")).distinct().toDF("node").withColumn("root", F.col("node")), "labels")
    links = materialize(both.distinct(), "links")
    while not links.isEmpty():
        hooks = materialize(links.groupBy("a").agg(F.min("b").alias("least"))
                            .select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "hooks")
        labels = labels.join(hooks.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = materialize(labels, "labels")
        near, far = hooks.toDF("a", "a_to"), hooks.toDF("b", "b_to")
        moved = links.join(near, "a").join(far, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = materialize(moved.filter("a <> b").distinct(), "links")
    return labels
