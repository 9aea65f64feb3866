"""Measures of images given as pixel tables: image columns, x, y and integer r, g, b, a.

Each is a grouped aggregate with partial sums before the shuffle. Where a measure needs an image's bounds first, pixels
are summed by row or column, and only these sums (at most one an image row) meet again. Sums are of integers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Alpha above which a pixel is visible, and the share of a figure's height that carries it.
VISIBLE, SUPPORT = 16, 0.1
#: Brightest channel and least spread of dark cloth; least luma and alpha of near white.
DARK, SPREAD, WHITE, SOLID = 80, 12, 240, 200
#: Alpha above which a pixel counts for edges; least channel and spread below which an edge is near white.
EDGE_VISIBLE, EDGE_WHITE, EDGE_SPREAD = 8, 220, 30
#: A glowing row's luma above the body's, its least luma, and the share of dark pixels it stays below.
GLOW_STEP, GLOW_LEAST, GLOW_DARK = 36, 170.0, 0.25


def visible(threshold: int = VISIBLE) -> Column:
    return F.col("a") > threshold


def _when(c: Column, value) -> Column:
    return F.when(c, value if isinstance(value, Column) else F.col(value))


def bounds(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE, clip: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Box of an image's visible pixels, and their number; nulls and 0 where none is. clip: half-open x1, y1, x2, y2."""
    seen = visible(threshold)
    if clip:
        x1, y1, x2, y2 = clip
        seen = seen & (F.col("x") >= F.floor(F.lit(x1))) & (F.col("y") >= F.floor(F.lit(y1))) & (F.col("x") < F.ceil(F.lit(x2))) & (F.col("y") < F.ceil(F.lit(y2)))
    return px.groupBy(*images).agg(
        *[f(_when(seen, c)).cast("long").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")],
        F.count(_when(seen, F.lit(1))).alias("opaque"),
    )


def _lines(px: DataFrame, images: Sequence[str], along: str, across: str, threshold: int) -> DataFrame:
    """Visible pixels of each row (along y) or column: first and last place across, number and sum of places."""
    c = F.col(across).cast("long")
    return px.where(visible(threshold)).groupBy(*images, along).agg(F.min(c).alias("first"), F.max(c).alias("last"), F.count("*").alias("n"), F.sum(c).alias("s"))


def anchors(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE, support: float = SUPPORT) -> DataFrame:
    """Places to hold an image by, doubled or as sums over n so that they stay whole: centre and centroid, the middle of
    the bottom edge, of the band that carries the figure, and of its lowest row. Images without visible pixels are left out.
    """
    rows = _lines(px, images, "y", "x", threshold)
    by = W.partitionBy(*images)  # one row for each image row
    low, high = F.max("y").over(by), F.min("y").over(by)
    band = F.greatest(F.lit(1), F.floor((low - high + 1) * support + 0.5))
    rows = rows.withColumn("low", low).withColumn("high", high).withColumn("carries", F.col("y") > low - band)
    sole = F.col("y") == F.col("low")
    return rows.groupBy(*images).agg(
        (F.min("first") + F.max("last") + 1).alias("centre_x2"),
        (F.first("high") + F.first("low") + 1).cast("long").alias("centre_y2"),
        F.sum("s").alias("sum_x"),
        F.sum(F.col("y") * F.col("n")).cast("long").alias("sum_y"),
        F.sum("n").alias("opaque"),
        (F.first("low") + 1).cast("long").alias("bottom_y"),
        (F.min(_when(F.col("carries"), "first")) + F.max(_when(F.col("carries"), "last")) + 1).alias("support_x2"),
        F.max(_when(sole, "s")).alias("sole_sum_x"),
        F.max(_when(sole, "n")).alias("sole_n"),
    )


def pixel_counts(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """All, transparent, dark-cloth and near-white pixels."""
    seen = visible(threshold)
    top, bottom = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    count = lambda c, name: F.count(_when(c, F.lit(1))).alias(name)
    return px.groupBy(*images).agg(
        F.count("*").alias("pixels"),
        count(F.col("a") == 0, "transparent"),
        count(seen & (top <= DARK) & (top - bottom > SPREAD), "dark"),
        count(seen & (0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b") >= WHITE) & (F.col("a") >= SOLID), "near_white"),
    )


def border_clear(px: DataFrame, images: Sequence[str], width: Column | int, height: Column | int, threshold: int = VISIBLE) -> DataFrame:
    """Visible pixels, and how many of the border's are clear."""
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    return px.groupBy(*images).agg(
        F.count(_when(visible(threshold), F.lit(1))).alias("opaque"),
        F.count(_when(edge, F.lit(1))).alias("border"),
        F.count(_when(edge & ~visible(threshold), F.lit(1))).alias("clear_border"),
    )


def corner_means(px: DataFrame, images: Sequence[str], width: Column | int, height: Column | int, patch: int = 16) -> DataFrame:
    """Sums and number of the pixels in each corner's square patch: corner is 0 top left, 1 top right, 2 and 3 below."""
    left, right, top, bottom = F.col("x") < patch, F.col("x") >= width - patch, F.col("y") < patch, F.col("y") >= height - patch
    corner = F.array_compact(F.array(*[F.when(h & v, i) for i, (v, h) in enumerate([(top, left), (top, right), (bottom, left), (bottom, right)])]))
    held = px.select(*images, "r", "g", "b", F.explode(corner).alias("corner"))
    return held.groupBy(*images, "corner").agg(*[F.sum(c).cast("long").alias(f"sum_{c}") for c in "rgb"], F.count("*").alias("n"))


def mass_bounds(px: DataFrame, images: Sequence[str], axis: str, low: float = 0.08, high: float = 0.92) -> DataFrame:
    """First places along an axis where the running alpha reaches the low and the high share of an image's alpha."""
    mass = px.groupBy(*images, axis).agg(F.sum("a").cast("long").alias("m"))
    by = W.partitionBy(*images)  # one row for each image row or column
    run = mass.withColumn("up", F.sum("m").over(by.orderBy(axis))).withColumn("total", F.sum("m").over(by)).where("total > 0")
    reach = lambda share: F.min(_when(F.col("up") >= F.col("total") * share, axis)).cast("long")
    return run.groupBy(*images).agg(reach(low).alias("low_place"), reach(high).alias("high_place"))


def long_axis(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """Direction of the visible pixels' longest spread in microradians, and both variances along it in thousandths.

    From integer moments: n times each covariance sum is whole.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    m = px.where(visible(threshold)).groupBy(*images).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"))
    n = F.col("n")
    a, b, c = n * F.col("xx") - F.col("sx") * F.col("sx"), n * F.col("yy") - F.col("sy") * F.col("sy"), n * F.col("xy") - F.col("sx") * F.col("sy")
    m = m.select(*images, "n", a.alias("a"), b.alias("b"), c.alias("c"))
    a, b, c = (F.col(k).cast("double") for k in "abc")
    root, area = F.sqrt((a - b) * (a - b) + 4 * c * c), F.col("n").cast("double") * F.col("n")
    whole = lambda v, unit: F.floor(v * unit + 0.5).cast("long")
    return m.select(*images, "n", whole(F.atan2(2 * c, a - b) / 2, 1e6).alias("angle_micro"), whole((a + b + root) / 2 / area, 1e3).alias("major_milli"), whole((a + b - root) / 2 / area, 1e3).alias("minor_milli"))


def squared_error(left: DataFrame, right: DataFrame, key: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """Summed squared colour difference, and its pixels: those visible in either image; a hidden pixel counts as black."""
    side = lambda px, p: px.where(visible(threshold)).select(*key, "x", "y", *[F.col(c).alias(f"{p}{c}") for c in "rgb"])
    both = side(left, "l").join(side(right, "r"), [*key, "x", "y"], "full_outer")
    d = [F.coalesce(f"l{c}", F.lit(0)) - F.coalesce(f"r{c}", F.lit(0)) for c in "rgb"]
    return both.groupBy(*key).agg(F.sum(sum((v * v for v in d[1:]), d[0] * d[0])).cast("long").alias("squared"), F.count("*").alias("pixels"))


def body_component(parts: DataFrame, images: Sequence[str], width: Column | int, least: float = 0.25) -> DataFrame:
    """An image's body among its components (count, width, height, centre_x): of those with a share of the largest's
    pixels the tallest for its width, then the tallest, the most central, the largest, the first."""
    by = W.partitionBy(*images)
    first = by.orderBy(F.desc(F.col("height") - F.col("width")), F.desc("height"), F.abs(F.col("centre_x") - (width - 1) / 2), F.desc("count"), "part_id")
    large = parts.withColumn("_top", F.max("count").over(by)).where(F.col("count") >= F.col("_top") * least)
    return large.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_top")


def edge_evidence(px: DataFrame, images: Sequence[str], width: Column | int, height: Column | int, threshold: int = EDGE_VISIBLE) -> DataFrame:
    """Visible pixels on the canvas' border, those beside a clear pixel or the border, and how many of these are near white.

    Each clear pixel marks its four neighbours, and marks are summed a pixel: one shuffle by pixel, none of pairs.
    """
    near = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    whole = lambda c: F.col(c).cast("long").alias(c)
    clear = px.where(~visible(threshold)).select(*images, F.explode(near).alias("at")).select(*images, F.col("at.x").cast("long").alias("x"), F.col("at.y").cast("long").alias("y"), F.lit(1).alias("mark"))
    low, high = F.least("r", "g", "b"), F.greatest("r", "g", "b")
    seen = px.where(visible(threshold)).select(*images, whole("x"), whole("y"), F.lit(0).alias("mark"), F.lit(1).alias("there"), ((low >= EDGE_WHITE) & (high - low < EDGE_SPREAD)).cast("int").alias("white"))
    marks = seen.unionByName(clear, allowMissingColumns=True).groupBy(*images, "x", "y").agg(F.max("mark").alias("mark"), F.max("there").alias("there"), F.max("white").alias("white")).where("there = 1")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    edge = border | (F.col("mark") == 1)
    return marks.groupBy(*images).agg(
        F.count(_when(edge, F.lit(1))).alias("edge_pixels"),
        F.count(_when(edge & (F.col("white") == 1), F.lit(1))).alias("white_edge"),
        F.count(_when(border, F.lit(1))).alias("boundary"),
    )


def sole_rows(lines: DataFrame, images: Sequence[str]) -> DataFrame:
    """lines: one row for each image row with pixels (images, y, n, luma sum, dark number, first, last) -> the row that a
    figure stands on, as sole_y.

    From below, rows of glow (bright, hardly dark) and of wide effects are passed over; below the middle also narrow
    debris and mixed rows. Where all rows fall out, the lowest that is neither glow nor effect is taken, else the lowest.
    An image's rows meet in one window, at most as many as it is high.
    """
    by = W.partitionBy(*images)
    r = lines.withColumn("mean", F.col("luma") / F.col("n")).withColumn("share", F.col("dark") / F.col("n")).withColumn("wide", F.col("last") - F.col("first") + 1)
    r = r.withColumn("_top", F.min("y").over(by)).withColumn("_low", F.max("y").over(by)).withColumn("_peak", F.max("dark").over(by))
    r = r.withColumn("_mid", F.col("_top") + F.greatest(F.lit(1), F.floor((F.col("_low") - F.col("_top") + 1) * 0.5)))
    r = r.withColumn("_width", F.max("last").over(by) - F.min("first").over(by) + 1)
    upper = lambda among, v: F.sort_array(F.collect_list(F.when(among, F.col(v))).over(by))
    middle = lambda c: F.get(F.col(c), F.floor(F.size(c) / 2).cast("int"))
    r = r.withColumn("_cores", upper((F.col("_peak") > 0) & (F.col("dark") >= F.col("_peak") * 0.5), "mean")).withColumn("_widths", upper(F.col("y") < F.col("_mid"), "wide"))
    core, body = F.coalesce(middle("_cores"), F.lit(0.0)), F.coalesce(middle("_widths"), F.col("_width"))
    glow = (F.col("mean") >= F.greatest(core + GLOW_STEP, F.lit(GLOW_LEAST))) & (F.col("share") < GLOW_DARK)
    effect = (body > 0) & (F.col("wide") >= F.greatest(body * 1.5, body + 6)) & (F.col("share") < 0.4)
    below = F.col("y") > F.col("_mid")
    debris = below & (body > 0) & (F.col("wide") < body * 0.55)
    mixed = below & (F.col("share") < 0.65) & (F.col("mean") >= core + 18)
    stands = ~(glow | effect)
    y = F.col("y").cast("long")
    return r.select(*images, y.alias("y"), stands.alias("stands"), (stands & ~(debris | mixed)).alias("firm")).groupBy(*images).agg(
        F.coalesce(F.max(F.when(F.col("firm"), F.col("y"))), F.max(F.when(F.col("stands"), F.col("y"))), F.max("y")).alias("sole_y")
    )


def hue_spread(df: DataFrame, groups: Sequence[str], degrees: Column) -> DataFrame:
    """Circular mean and deviation of angles in degrees, in thousandths; a group that has no direction deviates freely."""
    whole = lambda v, name: F.floor(F.col(v) * 1000 + 0.5).cast("long").alias(name)
    return circular(df, groups, degrees).select(*groups, "n", whole("mean", "mean_milli"), whole("deviation", "deviation_milli"))


def circular(df: DataFrame, groups: Sequence[str], degrees: Column) -> DataFrame:
    """groups, n, mean and deviation of angles, in degrees and not rounded, so that limits can be held against them."""
    rad = F.radians(degrees.cast("double"))
    s = df.groupBy(*groups).agg(F.sum(F.sin(rad)).alias("s"), F.sum(F.cos(rad)).alias("c"), F.count(degrees).alias("n")).where("n > 0")
    length = F.sqrt(F.pow(F.col("s") / F.col("n"), F.lit(2.0)) + F.pow(F.col("c") / F.col("n"), F.lit(2.0)))
    mean = F.pmod(F.degrees(F.atan2("s", "c")) + 360, F.lit(360.0))
    return s.select(*groups, "n", mean.alias("mean"), F.when(length >= 1, 0.0).otherwise(F.degrees(F.sqrt(-2 * F.log(length)))).alias("deviation"))


def cut_out(px: DataFrame, images: Sequence[str], width: int, height: int, plate: Column, threshold: int = VISIBLE) -> DataFrame:
    """images and cut: whether an image's background is gone already, judged by the band along its border.

    A band that is half plate says no, unless half of the inside is clear; one that is half clear says yes; else some
    plate says no where the inside isn't punched, and the outermost ring decides. plate: whether a pixel is studio plate.
    """
    depth = max(3, min(12, -(-min(width, height) * 4 // 100)))
    x, y = F.col("x"), F.col("y")
    band = (x < depth) | (x >= width - depth) | (y < depth) | (y >= height - depth)
    outer = (x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)
    clear = ~visible(threshold)
    n = lambda c, name: F.count_if(c).alias(name)
    counted = px.groupBy(*images).agg(n(band, "band"), n(band & clear, "clear"), n(band & ~clear & plate, "plates"), n(outer, "outer"), n(outer & clear, "open"), n(~band, "inside"), n(~band & clear, "holes"))
    share = lambda a, b: F.col(a) * 2 >= F.col(b)
    punched = (F.col("inside") > 0) & share("holes", "inside")
    verdict = F.when(F.col("band") == 0, False).when(share("plates", "band"), punched).when(share("clear", "band"), True).when((F.col("plates") > 0) & ~punched, False).otherwise((F.col("outer") > 0) & share("open", "outer"))
    small = F.lit(width < 2 or height < 2)
    return counted.select(*images, (verdict & ~small).alias("cut"), "band", "clear", "plates")


def frame_measurements(px: DataFrame, images: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """One record an image: body_width, body_height, feet_y, centre_y_x2 (doubled), opaque, near_white, and sole_x_milli,
    the middle of the pixels on the lowest row. Images without visible pixels have zeros.

    Pixels are summed by image row first, and only the rows meet again.
    """
    seen = visible(threshold)
    white = seen & (0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b") >= WHITE) & (F.col("a") >= SOLID)
    x = F.col("x").cast("long")
    rows = px.groupBy(*images, "y").agg(F.min(_when(seen, x)).alias("first"), F.max(_when(seen, x)).alias("last"), F.count_if(seen).alias("n"), F.count_if(white).alias("white"), F.sum(_when(seen, x)).alias("s"))
    held = F.col("n") > 0
    y = F.col("y").cast("long")
    lowest = F.max(F.when(held, F.struct(y.alias("y"), "s", "n")))
    top, low = F.min(F.when(held, y)), F.max(F.when(held, y))
    out = rows.groupBy(*images).agg(
        (F.max("last") - F.min("first") + 1).alias("body_width"), (low - top + 1).alias("body_height"), low.alias("feet_y"), (top + low).alias("centre_y_x2"),
        F.sum("n").alias("opaque"), F.sum("white").alias("near_white"), lowest.alias("_low"),
    )
    return out.withColumn("sole_x_milli", F.floor(F.col("_low.s") * 1000 / F.col("_low.n") + 0.5).cast("long")).drop("_low").fillna(0, ["body_width", "body_height", "feet_y", "centre_y_x2"])


def overlay(left: DataFrame, right: DataFrame, key: Sequence[str], threshold: int = VISIBLE) -> DataFrame:
    """key, x, y, r, g, b of the pixels visible in either image: white where in both, red where only in the left, cyan
    where only in the right."""
    side = lambda px, name: px.where(visible(threshold)).select(*key, "x", "y", F.lit(True).alias(name))
    both = side(left, "l").join(side(right, "r"), [*key, "x", "y"], "full_outer")
    on = lambda c: F.when(F.col(c), 255).otherwise(0)
    return both.select(*key, "x", "y", on("l").alias("red"), on("r").alias("rest")).select(*key, "x", "y", F.col("red").alias("r"), F.col("rest").alias("g"), F.col("rest").alias("b"))
