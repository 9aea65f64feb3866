"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.session import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of an orderable type -> node, label: the least node that it is connected with.

    A round lets each tree of nodes (those with one label) hook onto the least label beside it, and then shortens paths
    by following labels twice, so rounds grow with the logarithm of a component's width. A round's table is written to
    the shared folder and the one before is deleted; the driver sees only whether a label has changed. Joins are merges:
    stored files are so much smaller than their rows that they would be taken for tables to broadcast.
    """
    beside = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(beside.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        seen = beside.hint("merge").join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        own = labels.hint("merge").join(seen, "node")
        hooks = own.groupBy(F.col("label").alias("tree")).agg(F.min(F.least("label", "low")).alias("to"))
        again = hooks.select(F.col("tree").alias("to"), F.col("to").alias("further"))
        hooks = hooks.hint("merge").join(again, "to", "left").select("tree", F.coalesce("further", "to").alias("to"))
        moved = labels.hint("merge").join(hooks, F.col("label") == F.col("tree")).select("node", "to", (F.col("to") != F.col("label")).alias("moved"))
        following = stored(moved.withColumnRenamed("to", "label"), "labels")
        dropped(labels)
        labels = following.select("node", "label")
        if not following.where("moved").head(1):
            dropped(beside)
            return labels
        labels._stored_at = following._stored_at
