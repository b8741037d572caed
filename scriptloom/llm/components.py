"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node reachable from each node that has a link.

    Each round sends every node the smallest label among its neighbours and then the label of its label,
    so the number of rounds is near the logarithm of the longest path. Labels live in checkpointed tables; only
    a count of changes reaches the driver.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        made = cut(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")))
        if made.filter("label < was").isEmpty():
            return made.select("node", F.col("label").alias("component"))
        labels = made.select("node", "label")
