"""Connected components of an edge table, by rounds of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketmood.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); the label is the smallest
    node reachable.

    Each round takes the smallest label among a node's neighbours and then that label's
    own label, so paths shrink by more than half; rounds end when nothing changes. All
    state is in written tables; only a count reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    labels = stored(labels, "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = stored(hooked.join(ahead, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        if now.filter("label < old").limit(1).count() == 0:
            return now.select("node", "label")
        labels = now.select("node", "label")
