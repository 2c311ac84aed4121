"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of (u, v) rows; the label is the least node that can be reached.

    Every round takes the least label among a node's neighbours, gives it to the node that
    stands for the old label too, and then follows labels one step, so distances to the least node
    about halve: rounds grow with the logarithm of the longest path.  Neighbours are reduced to a minimum
    before the shuffle, so a hub is no large group.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct())
    now = stored(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    seen = None
    while True:
        near = both.join(now.select(F.col("node").alias("v"), F.col("label").alias("x")), "v").groupBy("u").agg(F.min("x").alias("x"))
        low = now.join(near.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "x").alias("x"))
        hook = low.groupBy("label").agg(F.min("x").alias("h")).withColumnRenamed("label", "node")
        hooked = stored(low.join(hook, "node", "left").select("node", F.least("x", "h").alias("x")))
        up = hooked.select(F.col("node").alias("x"), F.col("x").alias("label"))
        before, now = now, stored(hooked.join(up, "x").select("node", "label"))
        dropped(before, hooked)
        state = now.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if state == seen:
            dropped(both)
            return now
        seen = state
