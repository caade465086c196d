"""Connected components of graphs of many groups at once, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(_g, _id, _c) for every end of the undirected edges (_g, _u, _x): ``_c`` is the smallest id of its component.

    Each round a node takes the smallest label among itself and its
    neighbours, then the label of that label twice, so long paths shorten
    fast; labels are written each round.
    """
    both = edges.select("_g", "_u", "_x")
    both = stored(both.unionByName(both.select("_g", F.col("_x").alias("_u"), F.col("_u").alias("_x"))).distinct(), "edges")
    labels = stored(both.groupBy("_g", F.col("_u").alias("_id")).agg(F.min("_x").alias("_m")).select(
        "_g", "_id", F.least("_id", "_m").alias("_c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("_id", "_x"), ["_g", "_x"]).groupBy("_g", F.col("_u").alias("_id")).agg(
            F.min("_c").alias("_m"))
        low = stored(labels.join(near, ["_g", "_id"]).select("_g", "_id", F.col("_c").alias("_was"), F.least("_c", "_m").alias("_c")),
                     "labels")
        jump = low.select("_g", F.col("_id").alias("_c"), F.col("_c").alias("_to"))
        step = low.join(jump, ["_g", "_c"]).select("_g", "_id", "_was", F.col("_to").alias("_c"))
        step = stored(step.join(jump, ["_g", "_c"]).select("_g", "_id", "_was", F.col("_to").alias("_c")), "labels")
        labels = step.drop("_was")
        if step.where("_was != _c").isEmpty():
            return labels
