"""Connected components by least label: trees of labels are hooked onto smaller ones and flattened until nothing changes; lineage is cut every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.runtime import cut


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id of the component). ``nodes``: ``id``; ``edges``: ``a, b``, either way round, between ids of ``nodes``.

    Each round every edge offers its ends' grandparents to both the nodes and their parents (so whole trees are hooked at once), and each
    node takes the least of what it is offered and of its own grandparent: rounds grow with the logarithm of the longest chain. It runs until a round
    changes nothing, however many that takes. Null ids and loops tell nothing. Only a flag reaches the driver.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    both = cut(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.where("id is not null").select("id", F.col("id").alias("f"), F.col("id").alias("g")).distinct()
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        met = labels.join(near, labels["id"] == near["a"], "left").select("id", "f", "g", "m")
        offers = met.select("id", F.least("g", F.coalesce("m", "g")).alias("x")).unionByName(met.where("m is not null").select(F.col("f").alias("id"), F.col("m").alias("x")))
        new = offers.groupBy("id").agg(F.min("x").alias("f"))
        up = new.select(F.col("id").alias("f"), F.col("f").alias("g"))
        new = new.join(up, "f").join(labels.select("id", F.col("f").alias("f0"), F.col("g").alias("g0")), "id")
        new = cut(new.select("id", "f", "g", ((F.col("f") != F.col("f0")) | (F.col("g") != F.col("g0"))).alias("moved")))
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "f", "g")
        if not moved:
            return labels.select("id", F.col("f").alias("component"))
