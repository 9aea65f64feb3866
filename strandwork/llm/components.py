"""Connected components of an edge table by hooking and shortcutting, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> node, label: the least node of its component; isolated nodes don't occur.

    A round gives each node the least label of its neighbours and itself, then gives each former label the least that
    any of its nodes has got, so that whole trees move at once and paths shorten by a factor each round. Only pairs of
    keys move, minima are taken before each shuffle, and the driver sees one count a round. Self-loops and repeated
    edges are harmless; an empty table has no components.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        got = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "low").alias("low"))
        moved = got.groupBy("was").agg(F.min("low").alias("to"))
        # a label's own node may have moved further; follow it once
        follow = moved.select(F.col("was").alias("w2"), F.col("to").alias("to2"))
        moved = moved.join(follow, F.col("to") == F.col("w2"), "left").select("was", F.coalesce("to2", "to").alias("to"))
        new = got.join(moved, "was").select("node", F.least("low", "to").alias("label"), F.col("was"))
        new = stored(new, "labels")
        changed = new.where("label <> was").limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        labels._stored_at = new._stored_at
        if not changed:
            dropped(both)
            return labels
