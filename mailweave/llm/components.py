"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.store import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is its smallest node.

    Every round a node takes the smallest label of its neighbours and itself,
    then the label of that label, so that paths shorten by halves. All of it is
    joins and partial aggregates; each round is written, so lineage stays short
    and a lost executor costs one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    links = materialise(both, "links")
    labels = materialise(links.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        near = links.join(labels.hint("merge"), links.b == labels.node).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near.hint("merge"), labels.node == near.a).select("node", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("node").alias("at"), F.col("l").alias("further"))
        new = step.join(jump.hint("merge"), step.l == jump["at"], "left").select("node", "was", F.least("l", F.coalesce("further", "l")).alias("l"))
        written = materialise(new, "labels")
        changed = written.where("l <> was").limit(1).count()
        labels = written.select("node", "l")
        if not changed:
            return labels.select("node", F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def local_roots(n: int, a, b):
    """For links (a[i], b[i]) between 0..n-1, the smallest index of each one's component."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
