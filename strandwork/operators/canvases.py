"""Plans that move or scale the frames of clips on their canvases, and the pixels and points that follow a plan.

A geometry table has one row for each frame: clip columns, frame_index (0, 1, ... in a clip), width and height of its
canvas, min_x, min_y, max_x, max_y of what is visible, opaque (its pixels), feet_y, cx, fx and body_height; zeros where nothing is visible.
Points of a clip are measured from its anchor: the middle of a canvas' bottom edge, or its lower left corner.

A clip's bounds or pivot are partial aggregates joined back, one row a clip, so a clip that holds a third of all frames
is split like any other. Pixels meet their plan by their frame's keys and then only by arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.operators.rasters import VISIBLE, visible

#: Sides that a canvas may have.
LEAST_SIDE, MOST_SIDE = 1, 4096


def _round(v: Column) -> Column:
    return F.floor(v + 0.5).cast("long")


def geometry(px: DataFrame, soles: DataFrame, frame: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """frame, min_x, min_y, max_x, max_y, opaque, feet_y, cx, fx and body_height of images; soles: frame and sole_y where one is
    known, else the lowest visible row. cx is the middle of the box, fx that of the pixels on the sole.

    Pixels are summed by image row, and only the rows meet the soles.
    """
    x = F.col("x").cast("long")
    rows = px.groupBy(*frame, F.col("y").cast("long").alias("y")).agg(*[f(F.when(visible(threshold), x)).alias(n) for n, f in (("left", F.min), ("right", F.max), ("s", F.sum), ("n", F.count))])
    box = rows.groupBy(*frame).agg(F.min("left").alias("min_x"), F.max("right").alias("max_x"), F.min(F.when(F.col("n") > 0, F.col("y"))).alias("min_y"), F.max(F.when(F.col("n") > 0, F.col("y"))).alias("max_y"), F.sum("n").alias("opaque"))
    box = box.join(soles.select(*frame, F.col("sole_y").cast("long").alias("feet_y")), [*frame], "left").withColumn("feet_y", F.coalesce("feet_y", "max_y"))
    at = rows.select(*frame, F.col("y").alias("feet_y"), (F.col("s") / F.col("n")).alias("fx"))
    out = box.join(at, [*frame, "feet_y"], "left").withColumn("cx", (F.col("min_x") + F.col("max_x")) / 2)
    out = out.withColumn("body_height", F.col("feet_y") - F.col("min_y") + 1).withColumn("fx", F.coalesce("fx", "cx"))
    return out.fillna(0, ["min_x", "min_y", "max_x", "max_y", "feet_y", "body_height"]).fillna(0.0, ["cx", "fx"])


def plant_plan(frames: DataFrame, target: Column | int = -1) -> DataFrame:
    """frames with dx (0), dy, out_width and out_height: how far a frame moves down for its feet to stand on the target,
    counted from the canvas' bottom edge (the last row is -1). What hangs below the feet and touches the bottom edge is
    not counted to the canvas; a canvas grows at its foot where that would leave it."""
    hangs = F.greatest(F.lit(0), F.col("max_y") - F.col("feet_y"))
    floor = F.col("height") - F.when(F.col("max_y") >= F.col("height") - 1, hangs).otherwise(0)
    move = (F.lit(target) if isinstance(target, int) else target) - (F.col("feet_y") - floor)
    dy = F.when(move < 0, F.ceil(move)).otherwise(F.floor(move)).cast("long")
    out = frames.withColumn("dx", F.lit(0).cast("long")).withColumn("dy", dy).withColumn("out_width", F.col("width").cast("long"))
    return out.withColumn("out_height", F.greatest(F.col("height"), F.col("max_y") + F.col("dy") + 1).cast("long"))


def register_plan(frames: DataFrame, clip: Sequence[str], target: Column, pivot: int = 0, equalize: Column | bool = True, boxes: bool = False, by_feet: bool = False) -> DataFrame:
    """frames with scale, source_x, source_y, dest_x and dest_y: each is scaled about its feet and placed on the pivot's.

    The pivot is the clip's frame of that number, or its last. Heights meet the target each by its own scale (equalize)
    or all by the pivot's. boxes: heights of boxes, not of bodies. by_feet: frames meet at fx, not at cx. Scales have four
    decimals.
    """
    high = F.col("max_y") - F.col("min_y") + 1
    tall = high if boxes else F.when(F.col("body_height") > 0, F.col("body_height")).otherwise(high)
    x = F.col("fx" if by_feet else "cx")
    frames = frames.withColumn("_tall", F.greatest(F.lit(1), tall)).withColumn("source_x", x.cast("double")).withColumn("source_y", F.col("feet_y").cast("double"))
    first = frames.where(F.col("frame_index") <= pivot).groupBy(*clip).agg(F.max_by(F.struct("source_x", "source_y", "_tall"), "frame_index").alias("_pivot"))
    goal = F.greatest(F.lit(1.0), target.cast("double"))
    each = equalize if isinstance(equalize, Column) else F.lit(equalize)
    scale = goal / F.when(each, F.col("_tall")).otherwise(F.col("_pivot._tall"))
    out = frames.join(first, [*clip]).withColumn("scale", F.floor(scale * 10000 + 0.5) / 10000)
    return out.withColumn("dest_x", F.col("_pivot.source_x")).withColumn("dest_y", F.col("_pivot.source_y")).drop("_pivot", "_tall")


def scaled(px: DataFrame, plan: DataFrame, frame: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """The visible pixels of a plan's frames, scaled without interpolation; columns of px.

    A place on the new canvas takes the nearest old pixel. Each old pixel finds the places that take it: those in a
    span as wide as the scale, held against the rounding itself. So no grid of places is made and joined.
    """
    p = plan.select(*frame, "scale", "source_x", "source_y", "dest_x", "dest_y", "width", "height")

    def places(axis: str, most: str) -> Column:
        old, source, dest = F.col(axis), F.col(f"source_{axis}"), F.col(f"dest_{axis}")
        edge = lambda by: dest + (old + by - source) * F.col("scale")
        low = F.greatest(F.lit(0), F.floor(edge(-0.5)) - 1).cast("long")
        high = F.least(F.col(most) - 1, F.ceil(edge(0.5)) + 1).cast("long")
        span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        takes = F.filter(span, lambda v: _round(source + (v - dest) / F.col("scale")) == old)
        return F.when(F.col("scale") > 0, takes).otherwise(F.array(old.cast("long")))

    rest = [c for c in px.columns if c not in ("x", "y")]
    at = px.where(visible(threshold)).join(p, [*frame]).withColumn("_y", places("y", "height")).where(F.size("_y") > 0)
    at = at.withColumn("_x", places("x", "width")).withColumn("_y", F.explode("_y")).withColumn("_x", F.explode("_x"))
    return at.select(*rest, F.col("_x").alias("x"), F.col("_y").alias("y"))


def _anchor(width: Column, left: Column) -> Column:
    return F.when(left, 0.0).otherwise(width / 2)


def pad_plan(frames: DataFrame, width: Column, height: Column, left: Column) -> DataFrame:
    """frames with the plan of a canvas of that size about the same anchor; left: anchored at the lower left corner."""
    w, h = width.cast("long"), height.cast("long")
    out = frames.withColumn("out_width", w).withColumn("out_height", h)
    raw = (_anchor(F.col("out_width"), left) - _anchor(F.col("width"), left), (F.col("out_height") - F.col("height")).cast("double"))
    return _moves(out, raw, left)


def trim_plan(frames: DataFrame, clip: Sequence[str], left: Column, preserve: Column | bool = True, padding: int = 0) -> DataFrame:
    """frames with the plan of the smallest canvas that holds all that is visible in a clip's frames, once their anchors
    meet. preserve: the anchor stays where canvases have it; else the canvas ends at the box. A clip without anything
    visible has nulls. left must be the same for all of a clip's frames."""
    seen = F.col("opaque") > 0
    x, y = _anchor(F.col("width"), left), F.col("height")
    box = frames.where(seen).groupBy(*clip).agg(
        (F.min(F.col("min_x") - x) - padding).alias("_x1"), (F.min(F.col("min_y") - y) - padding).alias("_y1"),
        (F.max(F.col("max_x") + 1 - x) + padding).alias("_x2"), (F.max(F.col("max_y") + 1 - y) + padding).alias("_y2"),
    )
    keep = preserve if isinstance(preserve, Column) else F.lit(preserve)
    out = frames.join(box, [*clip], "left")
    wide = F.when(keep & left, F.ceil("_x2")).when(keep, F.ceil(F.greatest(-F.col("_x1"), F.col("_x2"))) * 2).otherwise(F.ceil(F.col("_x2") - F.col("_x1")))
    high = F.when(keep, F.ceil(-F.col("_y1"))).otherwise(F.ceil(F.col("_y2") - F.col("_y1")))
    out = out.withColumn("out_width", wide.cast("long")).withColumn("out_height", high.cast("long"))
    from_x = F.when(keep & left, 0.0).when(keep, -F.col("out_width") / 2).otherwise(F.col("_x1"))
    from_y = F.when(keep, -F.col("out_height")).otherwise(F.col("_y1"))
    return _moves(out, (-from_x - x, (-from_y - y).cast("double")), left).drop("_x1", "_y1", "_x2", "_y2")


def _moves(out: DataFrame, raw: tuple[Column, Column], left: Column) -> DataFrame:
    """dx and dy of pixels, shift_x and shift_y of points, exact (the anchor lies on whole pixels) and fits (sides allowed)."""
    side = lambda c: F.col(c).between(LEAST_SIDE, MOST_SIDE)
    out = out.withColumn("dx", _round(raw[0])).withColumn("dy", _round(raw[1])).withColumn("exact", (F.col("dx") == raw[0]) & (F.col("dy") == raw[1]))
    x = _anchor(F.col("width"), left) + F.col("dx") - _anchor(F.col("out_width"), left)
    return out.withColumn("shift_x", x).withColumn("shift_y", F.col("height") + F.col("dy") - F.col("out_height")).withColumn("fits", side("out_width") & side("out_height"))


def _followed(px: DataFrame, plan: DataFrame, frame: Sequence[str]) -> tuple[DataFrame, Column, Column, Column]:
    """px with their plan, their new places and whether these lie on the new canvas."""
    at = px.join(plan.select(*frame, "dx", "dy", "out_width", "out_height"), [*frame])
    x, y = (F.col("x") + F.col("dx")).cast("long"), (F.col("y") + F.col("dy")).cast("long")
    return at, x, y, (x >= 0) & (y >= 0) & (x < F.col("out_width")) & (y < F.col("out_height"))


def moved(px: DataFrame, plan: DataFrame, frame: Sequence[str]) -> DataFrame:
    """The pixels of a plan's frames at their new places, but for those that fall off; columns of px."""
    at, x, y, inside = _followed(px, plan, frame)
    rest = [c for c in px.columns if c not in ("x", "y")]
    return at.where(inside).select(*rest, x.alias("x"), y.alias("y"))


def clipped(px: DataFrame, plan: DataFrame, frame: Sequence[str]) -> DataFrame:
    """frame and the number of pixels with any alpha that a plan takes off the canvas, as clipped; 0 where none is."""
    at, _, _, inside = _followed(px, plan, frame)
    return at.groupBy(*frame).agg(F.count_if(~inside & (F.col("a") > 0)).alias("clipped"))
