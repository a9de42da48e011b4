"""Connected components in Spark rounds: min-label hooking with pointer jumping.

Each round (1) gives every node the smallest label among its neighbours, (2) hooks its old root to
that label, and (3) replaces each label by that label's label, so the number of rounds is about
logarithmic in the longest path. The label table and the edges are checkpointed in
spark.checkpoint.dir, so a round never recomputes those before it and survives lost executors.
Joins read plain tables on both sides, so adaptive execution can split a hot node's rows.

Before the rounds the edges are turned into stars: every node keeps the edge to its smallest neighbour, and its other
smaller neighbours get an edge to that one instead. Tasks that each found a forest of the same group then agree on
most edges, so the rounds carry about one edge a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.session import ready


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    No edges: an empty result. Repeated edges, loops and edges in either direction are allowed; an edge with a null end
    is none. A round at least halves the roots of a component that still meet, so `most_rounds` of 64 do for 2**64 nodes.
    """
    ready(edges.sparkSession)
    edges = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    star = least.select(F.col("least").alias("a"), "b").union(edges.join(least, "b").where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))).distinct()
    both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = labels.select("node", F.least("node", "label").alias("label")).checkpoint()
    total = lambda x: x.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    for _ in range(most_rounds):
        if before is None:
            return labels
        seen = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        near = labels.select("node", "label").union(seen).groupBy("node").agg(F.min("label").alias("label")).checkpoint()
        roots = labels.select("node", F.col("label").alias("root")).join(near, "node").select(F.col("root").alias("node"), "label")
        near = near.union(roots).groupBy("node").agg(F.min("label").alias("label")).checkpoint()
        up = near.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = near.join(up, "label").select("node", F.col("above").alias("label")).checkpoint()
        after = total(labels)
        if after == before:
            return labels
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
