"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeline.llm.common import pin


def components(links: DataFrame, pin: Callable[[DataFrame], DataFrame] = pin) -> DataFrame:
    """``node, label`` for every node of the long columns ``a, b``: label is the smallest node reachable.

    ``pin`` keeps what a round has found. Each round takes the smallest label among a node's neighbours and then the label of that label,
    so that rounds grow with the logarithm of a chain's length. Minima are folded in each task
    before rows move; what a hub's key gathers is a join's side that Spark may split.
    """
    both = pin(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = pin(step)
        far = step.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = pin(step.join(far, step["label"] == far["mid"]).select("node", "was", F.least("label", "far").alias("label")))
        moved = after.filter("was <> label").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
