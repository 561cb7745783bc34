"""Connected components of links by the least label of neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) as (node, label): label is the least node of the component. Nodes without links are left out.

    A round gives each node the least label among its own and its neighbours', then the label of that label. Stars
    take two rounds and a path of n nodes about log2(n). Each round is cut off by a checkpoint.
    """
    edges = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    edges = checkpointed(edges.distinct())
    labels = checkpointed(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        offered = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("offer"))
        lowered = labels.join(offered, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("next"), F.col("label").alias("before"))
        jumped = lowered.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left")
        labels_next = checkpointed(jumped.select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "before"))
        changed = labels_next.filter("label != before").limit(1).count()
        labels = labels_next.select("node", "label")
        if not changed:
            return labels
