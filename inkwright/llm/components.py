"""Connected components of a graph given as a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of `links` (a, b); the component is its smallest node.

    Local contraction: in each round nodes have another pseudo-random order, every node is merged into the first one among itself and
    its neighbours, links are renamed and their doubles and loops dropped, until none is left. In a random order a
    constant share of the linked nodes goes in every round, whatever the shape (a chain of n nodes loses two thirds), so there
    are about log(n) rounds. Then the renamings are composed backwards. Every table is a written one, so a lost
    executor costs one round at most and no plan grows with the rounds.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    renamed = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(renamed)), c).alias("o"), F.col(c).alias("to"))  # noqa: E731, B023
        # A node's neighbours in both directions; the first comes with a partial aggregate, so hubs are no hot spot.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = both.groupBy("a").agg(F.min(order("b")).alias("to")).select(F.col("a").alias("node"), F.least("to", order("a"))["to"].alias("to"))
        renamed.append(written(names, "names"))
        left = edges.join(renamed[-1].select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        pairs = left.join(renamed[-1].select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").select("a2", "b2")
        pairs = pairs.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = written(pairs, "edges")
    if not renamed:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    final = renamed[-1]
    for names in reversed(renamed[:-1]):
        last = final.select(F.col("node").alias("to"), F.col("to").alias("end"))
        final = written(names.join(last, "to", "left").select("node", F.coalesce("end", "to").alias("to")), "names")
    least = final.groupBy("to").agg(F.min("node").alias("component"))
    return final.join(least, "to").select("node", "component")
