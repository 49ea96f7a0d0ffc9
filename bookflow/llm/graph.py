"""Connected components of a table of links, by contraction of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import forget, small_or_not, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is its smallest node.

    In each round every node points to its smallest neighbour or to itself. These
    pointers make trees, whose nodes are named after their roots by doubling the
    pointers; links are renamed to the roots, and links inside a tree vanish. Every
    tree but those of single local minima joins two nodes or more, so the nodes
    with links at least halve in each round: O(log n) rounds of O(log n) doublings,
    a chain of any length included. The smallest node of a component never moves.

    Only counts reach the driver. The tables of a round are stored, which cuts the
    lineage, and deleted once the next ones stand.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    n, labels = edges.count(), None
    while n or labels is None:
        roots = rooted(edges)
        near = small_or_not(roots, 32 * 2 * n)
        if labels is None:
            found = roots.select("node", F.col("to").alias("component"))
        else:
            found = labels.join(near, labels["component"] == near["node"], "left").select(labels["node"], F.coalesce("to", "component").alias("component"))
        found = stored(found, "labels")
        if n:
            x = near.select(F.col("node").alias("a"), F.col("to").alias("ta"))
            y = near.select(F.col("node").alias("b"), F.col("to").alias("tb"))
            renamed = edges.join(x, "a").join(y, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            left = stored(renamed.filter("a <> b").distinct(), "links")
            n = left.count()
            forget(edges)
            edges = left
        forget(roots)
        if labels is not None:
            forget(labels)
        labels = found
    forget(edges)
    return labels


def rooted(edges: DataFrame) -> DataFrame:
    """(node, to): the root of each node's tree of pointers to smallest neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "pointers")
    size = 32 * now.count()
    while now.alias("x").join(small_or_not(now, size).alias("y"), F.col("x.to") == F.col("y.node")).filter("y.to <> y.node").limit(1).count():
        half = doubled(now, now, size)
        after = stored(doubled(half, half, size), "pointers")
        forget(now)
        now = after
    return now


def doubled(first: DataFrame, second: DataFrame, size: int) -> DataFrame:
    """Pointers of `first` followed by those of `second`, which has every node."""
    then = small_or_not(second.select(F.col("node").alias("via"), F.col("to").alias("end")), size)
    return first.join(then, first["to"] == then["via"]).select("node", F.col("end").alias("to"))
