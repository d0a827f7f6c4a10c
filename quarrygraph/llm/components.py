"""Connected components of a link table, by passing on the least label and following labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b), the label being the least node that can be reached.

    Each round takes the least label of a node's neighbours and then that label's own label, so that paths
    shorten by doubling; the table of labels is written each round. Hubs are summed up before they are shuffled.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        follow = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(step.join(follow, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        changed = new.where("old != label").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels._quarry_path = new._quarry_path
        if not changed:
            discard(both)
            return labels
