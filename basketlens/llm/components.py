"""Connected components of links between integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.shared import store


def component_labels(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached over ``links`` (a, b), for every node that has a link.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so long
    paths shorten by more than one step a round.  Labels are written after each round; only a count comes to the driver.
    """
    edges = store(links.where("a <> b").selectExpr("a", "b").union(links.where("a <> b").selectExpr("b", "a")).distinct(), "edges")
    if edges.isEmpty():
        return edges.selectExpr("a as node", "b as label")
    labels = store(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("hooked"))
        hooked = store(hooked, "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("hooked").alias("grand"))
        jumped = hooked.join(up, hooked.hooked == up.parent).select("node", F.col("grand").alias("label"), (F.col("grand") != F.col("label")).alias("changed"))
        jumped = store(jumped, "labels")
        if jumped.where("changed").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
