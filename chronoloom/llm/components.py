"""Connected components of a table of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """One row per linked node: node, label. ``links`` has columns a, b (long, not null).

    Each round every node joins the neighbour (or itself) whose hash of that round is smallest, and the
    links between the joined nodes go to the next round. Hashes change from round to round, so a long
    chain shrinks by a constant factor too. A hub is one row per task before the shuffle; links and labels
    are written after every round, and nothing but a count reaches the driver. The label of a node is the
    smallest node of its component.
    """
    both = links.where("a <> b").select("a", "b").distinct()
    edges = stages.write(both, "links")
    first = edges
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        ways = edges.union(edges.select("b", "a"))
        rank = lambda c: F.xxhash64(F.lit(turn), F.col(c))  # noqa: B023, E731
        ways = ways.select("a", "b").union(ways.select("a", F.col("a").alias("b")))
        joined = ways.groupBy("a").agg(F.min_by("b", F.struct(rank("b"), F.col("b"))).alias("to"))
        joined = stages.write(joined.withColumnRenamed("a", "node"), "joined")
        left = joined.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = joined.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        contracted = edges.join(left, "a").join(right, "b").where("ta <> tb")
        pair = contracted.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        edges, before = stages.write(pair, "links"), edges
        if labels is None:
            labels = joined.withColumnRenamed("to", "label")
        else:
            steps = joined.select(F.col("node").alias("label"), F.col("to").alias("next"))
            labels = labels.join(steps, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            labels = stages.write(labels, "labels")
        if before is not first:
            stages.drop(before)
    if labels is None:
        return first.select(F.col("a").alias("node"), F.col("a").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("node").alias("smallest"))
    return stages.write(labels.join(smallest, "label").select("node", F.col("smallest").alias("label")), "components")
