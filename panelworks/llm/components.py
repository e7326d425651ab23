"""Connected components of links by smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelworks.llm.staging import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links (a, b)``: the smallest id of its component.

    Each round takes the smallest label among neighbours and then the label of that label, so chains halve. Rounds are
    written tables; only the number of changed labels comes to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = stored(lower, "labels-near")
        jump = lower.select(F.col("node").alias("via"), F.col("label").alias("further"))
        stepped = lower.join(jump, F.col("label") == F.col("via"), "left").select(
            "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
        )
        stepped = stored(stepped, "labels")
        labels = stepped.select("node", "label")
        if not stepped.where("label <> old").limit(1).count():
            return labels
