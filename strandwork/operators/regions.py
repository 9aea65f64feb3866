"""Regions of images given as pixel tables: connected parts and their statistics, holes, thickness along the long axis.

An image's rows are cut into runs of neighbouring pixels; runs of neighbouring rows that touch are edges of a graph, and
its components are the regions. Pixels are summed into their run before anything else is shuffled, runs meet in strips of
a bounded width, and no task holds an image. Joins are merges: a table of images is small, but its pixels and runs are not,
and Spark would broadcast them by the size of the images' file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.graph import components
from strandwork.operators.rasters import EDGE_VISIBLE, VISIBLE

#: A part is noise below so many pixels and below this share of the image.
LEAST_PIXELS, LEAST_SHARE = 4, 0.0005
#: Bins of a thickness profile; an axis leaves the canvas' directions where the covariance exceeds a share of
#: the larger variance, and follows the box where one side is so many times the other; fewest pixels of an axis.
BINS, OBLIQUE, OBLONG, AXIS_PIXELS = 24, 0.15, 1.15, 8
#: Width of the strips in which runs of neighbouring rows meet.
STRIP = 64


def _runs(px: DataFrame, images: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """images, y, x1, x2 and summed measures of the runs of pixels of an image's rows."""
    place = F.row_number().over(W.partitionBy(*images, "y").orderBy("x"))
    island = px.withColumn("_island", F.col("x") - place)
    sums = [F.sum(v).cast("long").alias(k) for k, v in measures.items()]
    runs = island.groupBy(*images, "y", "_island").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), *sums)
    return runs.drop("_island").withColumn("node", F.struct(*images, "y", F.col("x1").alias("x")))


def _touching(runs: DataFrame, images: Sequence[str], reach: int) -> DataFrame:
    """Edges (a, b) between runs of neighbouring rows that overlap once widened by reach: 0 joins by sides, 1 by corners too.

    Runs meet in the strips that they lie in, and a pair counts in the first that both have, so that a row of many runs
    is never multiplied by itself.
    """
    strips = lambda low, high: F.explode(F.sequence(F.floor(low / STRIP), F.floor(high / STRIP))).alias("strip")
    upper = runs.select(*images, (F.col("y") + 1).alias("y"), (F.col("x1") - reach).alias("u1"), (F.col("x2") + reach).alias("u2"), F.col("node").alias("a"))
    upper = upper.select("*", strips(F.col("u1"), F.col("u2")))
    lower = runs.select(*images, "y", "x1", "x2", F.col("node").alias("b"), strips(F.col("x1"), F.col("x2")))
    meet = (F.col("u1") <= F.col("x2")) & (F.col("x1") <= F.col("u2")) & (F.col("strip") == F.floor(F.greatest("u1", "x1") / STRIP))
    return upper.hint("merge").join(lower, [*images, "y", "strip"]).where(meet).select("a", "b")


def _labelled(px: DataFrame, images: Sequence[str], reach: int, measures: dict[str, Column]) -> DataFrame:
    """Runs with the first pixel of their region as label."""
    runs = _runs(px, images, measures)
    labels = components(_touching(runs, images, reach))
    return runs.hint("merge").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _on_border(width: Column | int, height: Column | int) -> Column:
    return (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)


def part_statistics(px: DataFrame, images: Sequence[str], width: int, height: int, threshold: int = VISIBLE) -> DataFrame:
    """The parts of visible pixels joined by sides or corners, numbered in the order in which their first pixels are read.

    Boxes and counts are whole; centre, fill, aspect, ratio of the principal variances, luma and chroma are weighted by
    alpha as they have to be, and given in thousandths, as is the share of pixels on the border. noise: fewer pixels than
    the least number or than the least share of the canvas.
    """
    x, y, a = (F.col(c).cast("long") for c in ("x", "y", "a"))
    luma = F.col("r").cast("long") * 2126 + F.col("g").cast("long") * 7152 + F.col("b").cast("long") * 722
    chroma = (F.greatest("r", "g", "b") - F.least("r", "g", "b")).cast("long")
    measures = {"n": F.lit(1), "m": a, "sx": x * a, "sy": y * a, "sxx": x * x * a, "sxy": x * y * a, "syy": y * y * a, "luma": luma * a, "chroma": chroma * a, "edge": _on_border(width, height).cast("int")}
    runs = _labelled(px.where(F.col("a") > threshold), images, 1, measures)
    box = [F.min("x1").alias("min_x"), F.min("y").alias("min_y"), F.max("x2").alias("max_x"), F.max("y").alias("max_y")]
    parts = runs.groupBy(*images, "label").agg(*[c.cast("long").alias(k) for c, k in zip(box, ("min_x", "min_y", "max_x", "max_y"), strict=True)], *[F.sum(k).alias(k) for k in measures])
    m = F.col("m").cast("double")
    cx, cy = F.col("sx") / m, F.col("sy") / m
    xx, yy = F.greatest(F.lit(0.0), F.col("sxx") / m - cx * cx), F.greatest(F.lit(0.0), F.col("syy") / m - cy * cy)
    xy = F.col("sxy") / m - cx * cy
    root = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    ratio = F.greatest(F.lit(0.0), (xx + yy + root) / 2) / F.greatest(F.lit(1e-6), (xx + yy - root) / 2)
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    milli = lambda v, name: F.floor(v * 1000 + 0.5).cast("long").alias(name)
    least = F.greatest(F.lit(LEAST_PIXELS), F.ceil(F.lit(width * height * LEAST_SHARE)))
    number = F.row_number().over(W.partitionBy(*images).orderBy("label")).cast("long") - 1
    return parts.select(
        *images, number.alias("part_id"), "min_x", "min_y", "max_x", "max_y", F.col("n").alias("count"), F.col("m").alias("alpha"), milli(cx, "centre_x_milli"), milli(cy, "centre_y_milli"),
        milli(F.col("n") / (w * h), "fill_milli"), milli(F.greatest(w, h) / F.least(w, h), "aspect_milli"), milli(ratio, "spread_milli"), milli(F.col("luma") / m / 10_000, "luma_milli"),
        milli(F.col("chroma") / m, "chroma_milli"), milli(F.col("edge") / F.col("n"), "border_milli"), (F.col("n") < least).alias("noise"),
    )


def holes(px: DataFrame, images: Sequence[str], width: int, height: int, threshold: int = EDGE_VISIBLE) -> DataFrame:
    """Regions of clear pixels, joined by sides, that don't reach the border: their number and their pixels, 0 for none."""
    clear = _labelled(px.where(F.col("a") <= threshold), images, 0, {"n": F.lit(1), "edge": _on_border(width, height).cast("int")})
    inner = clear.groupBy(*images, "label").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge")).where("edge = 0")
    found = inner.groupBy(*images).agg(F.count("*").alias("holes"), F.sum("n").alias("hole_pixels"))
    return px.select(*images).distinct().hint("merge").join(found, list(images), "left").fillna(0, ["holes", "hole_pixels"])


def axes(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """images with enough pixels, and their axis: mean_x, mean_y, axis_x, axis_y. A box that is clearly oblong and whose
    pixels don't lean gives a straight axis, else the direction of the longest spread does."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = px.where(F.col("a") > threshold).groupBy(*images).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
        (F.max(x) - F.min(x)).alias("wide"), (F.max(y) - F.min(y)).alias("high"),
    ).where(F.col("n") >= AXIS_PIXELS)
    n = F.col("n")
    about = lambda s, a, b: (n * F.col(s) - F.col(a) * F.col(b)) / n
    m = sums.select(*images, (F.col("sx") / n).alias("mean_x"), (F.col("sy") / n).alias("mean_y"), "wide", "high", about("sxx", "sx", "sx").alias("xx"), about("sxy", "sx", "sy").alias("xy"), about("syy", "sy", "sy").alias("yy"))
    xx, xy, yy = F.col("xx"), F.col("xy"), F.col("yy")
    straight = F.abs(xy) <= OBLIQUE * F.greatest(xx, yy, F.lit(1))
    half = (xx + yy) / 2
    along = half + F.sqrt(F.greatest(F.lit(0.0), half * half - (xx * yy - xy * xy))) - yy
    upright = (straight & (F.col("high") >= F.col("wide") * OBLONG)) | ((xy == 0) & (yy > xx) & ~(straight & (F.col("wide") >= F.col("high") * OBLONG)))
    level = (straight & (F.col("wide") >= F.col("high") * OBLONG)) | (xy == 0)
    length = F.sqrt(along * along + xy * xy)
    pick = lambda when_up, when_level, value: F.when(upright, when_up).when(level, when_level).otherwise(value / length)
    return m.select(*images, "mean_x", "mean_y", pick(0.0, 1.0, along).alias("axis_x"), pick(1.0, 0.0, xy).alias("axis_y"))


def thickness(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE, bins: int = BINS) -> DataFrame:
    """images, bin, pixels, thickness_milli: how wide an image is across its long axis, in bins from the axis' low end to
    its high end; one row for every bin, thickness null where it has no pixels; widest marks the first of the widest bins.

    Pixels join their image's axis and are then only summed: its span first, by a window over the image, then its bins.
    """
    seen = px.where(F.col("a") > threshold).join(axes(px, images, threshold), list(images))
    dx, dy = F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y")
    placed = seen.select(*images, (dx * F.col("axis_x") + dy * F.col("axis_y")).alias("along"), (dy * F.col("axis_x") - dx * F.col("axis_y")).alias("across"))
    ends = placed.groupBy(*images).agg(F.min("along").alias("low"), F.max("along").alias("high"))
    span = F.greatest(F.lit(0.0001), F.col("high") - F.col("low"))
    bin_ = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("along") - F.col("low")) / span * bins))).cast("long")
    held = placed.join(ends, list(images)).groupBy(*images, bin_.alias("bin")).agg(F.count("*").alias("pixels"), F.floor((F.max("across") - F.min("across")) * 1000 + 0.5).cast("long").alias("thickness_milli"))
    every = ends.select(*images, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    out = every.join(held, [*images, "bin"], "left").fillna(0, ["pixels"])
    first = F.row_number().over(W.partitionBy(*images).orderBy(F.desc_nulls_last("thickness_milli"), "bin"))
    return out.withColumn("widest", first == 1)
