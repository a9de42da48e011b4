"""Relational graph search: frontiers as DataFrames, for one-to-many costs where a link's cost is fixed.

Each step joins the frontier with the links, keeps the smallest cost of each (source, node), and goes on
with what improved. Steps are bounded by the caller; lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.progress import report
from navloom.session import ready


def relax(links: DataFrame, sources: DataFrame, steps: int, within: Column | None = None) -> DataFrame:
    """(source, node, cost, parent): the cheapest way from each source (source, node) within `steps` links (src, dst, cost).

    `within` is a condition on (source, node, cost) that reached nodes must meet, such as a circle or a shape
    around the source. Ties: the smallest parent. Stops early when nothing improves. Links with a null end or cost
    lead nowhere; repeated links and sources count once.
    """
    ready(links.sparkSession)
    best = sources.select("source", "node", F.lit(0).cast("double").alias("cost"), F.lit(None).cast("long").alias("parent")).distinct()
    frontier = best
    links = links.select(F.col("src").alias("node"), "dst", F.col("cost").cast("double").alias("step")).checkpoint()
    least = lambda t: t.groupBy("source", "node").agg(F.min(F.struct("cost", "parent")).alias("b")).select("source", "node", "b.*")
    for step in range(steps):
        reached = frontier.join(links, "node").select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.col("node").alias("parent"))
        reached = least(reached if within is None else reached.where(within))
        known = best.groupBy("source", "node").agg(F.min("cost").alias("__old"))
        # Only what improved is written; what is known stays a union of such tables, of which the least cost counts.
        frontier = reached.join(known, ["source", "node"], "left").where(F.col("__old").isNull() | (F.col("cost") < F.col("__old"))).drop("__old").checkpoint()
        report("relax", step=step + 1, of=steps)
        if frontier.isEmpty():
            break
        best = best.union(frontier)
    return least(best)


def chains(best: DataFrame, most: int) -> DataFrame:
    """(source, node, path): the nodes from the source to each node, following parents; at most `most` long, cut at its end.

    Parents must lead to a source, as those of `relax` do; a parent that is not there ends the chain.
    """
    ready(best.sparkSession)
    # Each round joins the chains to themselves: after n rounds they are 2**n long, so a few rounds do for any length.
    t = best.select("source", "node", F.array("node").alias("path"), F.col("parent").alias("at")).checkpoint()
    while not t.where(F.col("at").isNotNull()).isEmpty():
        up = t.select("source", F.col("node").alias("at"), F.col("path").alias("__above"), F.col("at").alias("__next"))
        t = t.join(up, ["source", "at"], "left").select("source", "node", F.concat(F.coalesce("__above", F.array().cast("array<long>")), "path").alias("path"), F.col("__next").alias("at")).checkpoint()
    return t.select("source", "node", F.slice("path", 1, most).alias("path"))
