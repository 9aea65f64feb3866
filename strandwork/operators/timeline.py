"""Timeline arithmetic: playback durations, export delays, keyframe interpolation, poses at a time, sweep samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Halves up, also below zero."""
    return F.floor(x + 0.5)


def playback_durations(seq: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """seq with play_duration: the override's, else the frame's own, else 1; 0 where the override disables the frame."""
    o = overrides.select(*keys, F.col("duration").alias("_d"), F.col("disabled").alias("_off"))
    d = F.when(F.coalesce("_off", F.lit(False)), 0.0).otherwise(F.coalesce(F.when(F.col("_d") > 0, F.col("_d")), F.when(F.col("duration") > 0, F.col("duration")), F.lit(1.0)))
    return seq.join(o, list(keys), "left").withColumn("play_duration", d).drop("_d", "_off")


def scales(seq: DataFrame, overrides: DataFrame, keys: Sequence[str], group_scale: Column) -> DataFrame:
    """seq with scale: the frame's override if positive, else the group's if positive, else 1."""
    o = overrides.select(*keys, F.col("scale").alias("_s"))
    s = F.coalesce(F.when(F.col("_s") > 0, F.col("_s")), F.when(group_scale > 0, group_scale), F.lit(1.0))
    return seq.join(o, list(keys), "left").withColumn("scale", s).drop("_s")


def delay_centiseconds(seconds: Column) -> Column:
    """Export delay: hundredths, halves up, at least one; null when it exceeds 65535."""
    d = F.greatest(F.lit(1), round_half_up(seconds * 100)).cast("long")
    return F.when(d <= 65535, d)


def interpolate(keys: DataFrame, groups: Sequence[str], values: Sequence[str], angle: str | None = None, steps: Sequence[str] = (), mode: str = "linear", shortest: bool = True) -> DataFrame:
    """A row for each frame between a group's first and last key. keys: groups, frame and value columns.

    mode: linear, smooth (smoothstep) or hold. The angle, in radians, turns the shorter way unless told otherwise; step
    columns change at keys only.
    """
    by = W.partitionBy(*groups).orderBy("frame")
    cols = [*values, *([angle] if angle else []), *steps]
    seg = keys
    for c in ["frame", *cols]:
        seg = seg.withColumn(f"next_{c}", F.lead(c).over(by))
    # each key starts a segment up to the frame before the next; the last key is a segment of its own
    until = F.coalesce(F.col("next_frame") - 1, F.col("frame"))
    out = seg.withColumn("at", F.explode(F.sequence("frame", until)))
    t = F.when(F.col("next_frame").isNull(), 0.0).otherwise((F.col("at") - F.col("frame")) / (F.col("next_frame") - F.col("frame")))
    if mode == "hold":
        t = F.lit(0.0)
    elif mode == "smooth":
        t = t * t * (3 - 2 * t)
    out = out.withColumn("t", t)
    mixed = [(F.col(v) + F.coalesce(F.col(f"next_{v}") - F.col(v), F.lit(0.0)) * F.col("t")).alias(v) for v in values]
    if angle:
        turn = F.coalesce(F.col(f"next_{angle}") - F.col(angle), F.lit(0.0))
        if shortest:
            turn = F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi
        mixed.append((F.col(angle) + F.when(F.col("t") == 0, 0.0).otherwise(turn * F.col("t"))).alias(angle))
    return out.select(*groups, F.col("at").cast("long").alias("frame"), *mixed, *steps)


def pose_at(poses: DataFrame, times: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values at given times, linear between the bracketing poses and clamped at the ends.

    poses: groups, arrival, values; times: groups, time. Both sides are laid on one line a group, and the last pose at or
    before and the first at or after each time are carried along: a shuffle on the groups, no range join.
    """
    p = poses.select(*groups, F.col("arrival").alias("x"), F.struct("arrival", *values).alias("pose"), F.lit(None).cast("double").alias("time"))
    t = times.select(*groups, F.col("time").cast("double").alias("x"), F.lit(None).cast(p.schema["pose"].dataType).alias("pose"), F.col("time").cast("double").alias("time"))
    by, down = W.partitionBy(*groups).orderBy("x"), W.partitionBy(*groups).orderBy(F.desc("x"))
    line = (
        p.union(t)
        .withColumn("left", F.last("pose", True).over(by.rangeBetween(W.unboundedPreceding, 0)))
        .withColumn("right", F.last("pose", True).over(down.rangeBetween(W.unboundedPreceding, 0)))
        .where("time IS NOT NULL")
    )
    a, b = F.coalesce("left", "right"), F.coalesce("right", "left")
    span = F.greatest(F.lit(1e-6), b["arrival"] - a["arrival"])
    share = F.least(F.greatest((F.col("time") - a["arrival"]) / span, F.lit(0.0)), F.lit(1.0))
    return line.select(*groups, "time", *[(a[v] + (b[v] - a[v]) * share).alias(v) for v in values])


def sweep_samples(spans: DataFrame, groups: Sequence[str], rate: int = 60) -> DataFrame:
    """spans: groups, arrival, next_arrival -> sample times, ceil(span * rate) even steps from each arrival."""
    width = F.col("next_arrival") - F.col("arrival")
    steps = F.greatest(F.lit(1), F.ceil(width * rate)).cast("int")
    return spans.withColumn("steps", steps).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("time", F.col("arrival") + width * F.col("step") / F.col("steps"))


def fade(age: Column, lifetime: Column | float) -> Column:
    """Opacity of a sweep: (1 - age / lifetime) ** 1.5 inside the lifetime, else 0."""
    life = lifetime if isinstance(lifetime, Column) else F.lit(lifetime)
    left = 1 - age / life
    return F.when((age >= 0) & (left > 0), F.pow(left, F.lit(1.5))).otherwise(0.0)


def played(seq: DataFrame, overrides: DataFrame, keys: Sequence[str], groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The frames that no override disables, numbered anew from 0 as new_index, and groups with kept and skipped counts."""
    off = overrides.where(F.coalesce("disabled", F.lit(False))).select(*keys).distinct().withColumn("_off", F.lit(True))
    marked = seq.join(off, list(keys), "left")
    counts = marked.groupBy(*groups).agg((F.count("*") - F.count("_off")).alias("kept"), F.count("_off").alias("skipped"))
    place = F.row_number().over(W.partitionBy(*groups).orderBy("frame_index")).cast("long") - 1
    return marked.where("_off IS NULL").drop("_off").withColumn("new_index", place), counts
