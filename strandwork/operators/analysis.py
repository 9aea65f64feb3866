"""Holds, jumps, motion and scale of sequences in one pass: one exchange by sequence and one sort, whatever is asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators.sequences import _by, _holds, at_rest, closeness


def analyse(seq: DataFrame, groups: Sequence[str], measure: str, threshold: float = 88.0, sim=None) -> DataFrame:
    """One row a sequence: frames, holds (structs of frame_index and match_index), jumps (frame_index, score), start_frame
    and end_frame of its motion, activity, and least, most and middle measure (the upper one of two).

    Windows mark each frame against its neighbours, the opening and the frame before; stretches of neighbouring likes are
    gathered for the fold that finds holds, and everything else is added up beside it. Both steps keep the partitioning
    that the windows need, so rows are shuffled once and sorted once. A sequence's measures, one number a frame, meet in
    its row for the middle one.
    """
    sim = sim or closeness()
    by, m = _by(groups), F.col(measure)
    before, after = F.lag(measure).over(by), F.lead(measure).over(by)
    score = sim(before, after) - F.least(sim(before, m), sim(m, after))
    marked = seq.select(
        *groups, "frame_index", m.alias("m"), score.alias("score"), at_rest(m, F.first(measure).over(by)).alias("rest"),
        F.coalesce(F.abs(m - before), F.lit(0)).alias("step"), F.coalesce((sim(before, m) < threshold).cast("int"), F.lit(0)).alias("cut"),
    ).withColumn("stretch", F.sum("cut").over(by))
    place = F.col("frame_index").cast("long")
    jump = (F.col("score") > 0) & (F.col("score") >= 100 - threshold)
    parts = marked.groupBy(*groups, "stretch").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("frame_index"), "m"))).alias("f"),
        F.array_sort(F.collect_list(F.when(jump, F.struct(place.alias("frame_index"), "score")))).alias("jumps"),
        F.min(F.when(~F.col("rest"), place)).alias("moved"), F.max(F.when(~F.col("rest"), place)).alias("last_moved"),
        F.max(F.struct(place.alias("at"), "rest")).alias("last"), F.sum("step").alias("step"),
    )
    held = _holds(F.transform("f", lambda x: x["m"]), sim, F.lit(float(threshold)), 2)
    parts = parts.withColumn("holds", F.transform(held, lambda x: F.struct(F.get("f", x["index"])["frame_index"].alias("frame_index"), F.get("f", x["anchor"])["frame_index"].alias("match_index"))))
    values = F.transform("f", lambda x: x["m"])
    parts = parts.select("*", F.size("f").alias("n"), F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    joined = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    whole = parts.groupBy(*groups).agg(
        F.sum("n").alias("frames"), joined("holds").alias("holds"), joined("jumps").alias("jumps"), F.min("moved").alias("moved"), F.max("last_moved").alias("last_moved"),
        F.max("last").alias("last"), F.sum("step").alias("activity"), F.min("low").alias("least"), F.max("high").alias("most"), F.flatten(F.collect_list(values)).alias("all"),
    )
    ended = F.when(F.col("moved").isNull() | ~F.col("last.rest"), F.col("last.at")).otherwise(F.col("last_moved"))
    middle = F.get(F.sort_array("all"), F.floor(F.col("frames") / 2).cast("int"))
    return whole.select(
        *groups, "frames", F.when(F.col("frames") >= 3, F.col("holds")).otherwise(F.array().cast("array<struct<frame_index:bigint,match_index:bigint>>")).alias("holds"), "jumps",
        F.coalesce("moved", F.lit(0)).cast("long").alias("start_frame"), ended.alias("end_frame"), "activity", "least", "most", middle.alias("middle"),
    )
