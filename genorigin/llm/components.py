"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """links: (a, b) of one ordered type. Returns (node, root): for every linked node, the smallest node it can reach.

    Each round gives every node the smallest root among its neighbours', hooks its own old root to it as well, and then takes the root's root. Roots reach
    across a component in a number of rounds that grows with the logarithm of its width. All steps are joins and minima with partial aggregation; labels
    are written to the shared folder twice a round, which keeps the plan short and leaves both sides of the join on roots to be read from shuffles, so that the root of a large star
can be split among tasks. The driver sees one count a round.
    """
    both = links.where("a <> b").select("a", "b")
    both = stored(both.union(both.select("b", "a")).distinct(), name)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name)
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        seen = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hooked = seen.where("low < root").select(F.col("root").alias("node"), "low")
        lower = stored(seen.select("node", "low").union(hooked).groupBy("node").agg(F.min("low").alias("low")), name)
        up = lower.select(F.col("node").alias("parent"), F.col("low").alias("upper"))
        jumped = lower.join(up, lower["low"] == up["parent"], "left").select("node", F.least("low", F.coalesce("upper", "low")).alias("root"))
        after = stored(jumped, name)
        old = labels.withColumnRenamed("root", "old")
        changed = after.join(old, "node").where("root <> old").limit(1).count()
        labels = after
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
