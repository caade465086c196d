"""Connected components of a table of links, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Each round a node takes the smallest label among itself and its
    neighbours, then the label of that label, so paths shorten by half; it ends
    when no label changes. Labels are written each round, which cuts the
    lineage. A node of high degree sends one row per link, and minima combine
    before the shuffle.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stored(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("component").alias("was"), F.least("component", "m").alias("now"))
        up = labels.select(F.col("node").alias("x"), F.col("component").alias("y"))
        step = stored(low.join(up, low["now"] == up["x"]).select("node", "was", F.least("now", "y").alias("component")),
                      "labels")
        labels = step.select("node", "component")
        if step.where(F.col("was") != F.col("component")).isEmpty():
            return labels
