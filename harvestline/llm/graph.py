"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harvestline.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b long): the smallest node reachable.
    Rounds of taking the smallest label among the neighbours and following labels to theirs,
    until none changes; a hub's neighbours are folded before the shuffle."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        ahead = labels.select(F.col("node").alias("low"), F.col("component").alias("ahead"))
        new = stored(step.join(ahead, "low").select("node", F.least("low", "ahead").alias("component"), (F.least("low", "ahead") < F.col("component")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
