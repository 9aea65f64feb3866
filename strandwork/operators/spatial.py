"""Boxes, cells and the join of labelled boxes to components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.session import dropped, stored

#: Fixed value: the ratio of intersection to union that ties a hand to a point of contact.
HAND_RATIO = 0.2


def cell_grid(views: DataFrame, columns: int, rows: int) -> DataFrame:
    """views with x, y, width, height -> a row for each cell: its speakable id (A1 ...) and box."""
    grid = views.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rows))))
    left = lambda k: F.col("x") + k * F.col("width") / columns
    top = lambda k: F.col("y") + k * F.col("height") / rows
    cell = F.concat(F.char(F.col("c") + 65), F.col("r").cast("string"))
    return grid.select(*views.columns, cell.alias("cell"), left(F.col("c")).alias("x1"), left(F.col("c") + 1).alias("x2"), top(F.col("r") - 1).alias("y1"), top(F.col("r")).alias("y2"))


def intersection(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Area that two boxes (x1, y1, x2, y2) share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def area(a: Sequence[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def best_overlaps(boxes: DataFrame, parts: DataFrame, groups: Sequence[str], affinity: Column, least: float = 0.25, cell: float = 64.0) -> DataFrame:
    """Each labelled box with the part that grounds it best, or no row.

    boxes: groups, box_id, bx1..by2; parts: groups, part_id, px1..py2 and what affinity needs. A part grounds a box if it
    covers the least share of it; the highest affinity wins, then the largest share, then the smallest part_id. Boxes and
    parts meet in the strips of ``cell`` width that they lie in, each pair in the first strip that both have, so a group
    is never multiplied as a whole. A box should be no wider than a few strips.
    """
    met = _met(boxes, parts, groups, cell).where(F.col("share") >= least).withColumn("affinity", affinity)
    first = F.row_number().over(W.partitionBy(*groups, "box_id").orderBy(F.desc("affinity"), F.desc("share"), "part_id"))
    return met.withColumn("_r", first).where("_r = 1").drop("_r")


def _met(boxes: DataFrame, parts: DataFrame, groups: Sequence[str], cell: float) -> DataFrame:
    """Boxes and parts that share a strip, with the share of the box that the part covers."""
    b, p = [F.col(f"b{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"p{c}") for c in ("x1", "y1", "x2", "y2")]
    strip = lambda c: F.floor(F.col(c) / cell)
    strips = lambda df, p: df.withColumn("_s", F.explode(F.sequence(strip(f"{p}x1"), F.greatest(strip(f"{p}x1"), strip(f"{p}x2")))))
    both = strips(boxes, "b").join(strips(parts, "p"), [*groups, "_s"]).where(F.col("_s") == F.greatest(strip("bx1"), strip("px1"))).drop("_s")
    return both.withColumn("share", intersection(b, p) / F.greatest(F.lit(1), area(b)))


def overlap_ratio(b: Sequence[Column], p: Sequence[Column]) -> Column:
    """Intersection over union of two boxes."""
    both = intersection(b, p)
    return both / F.greatest(F.lit(1), area(b) + area(p) - both)


def exclusive_overlaps(boxes: DataFrame, parts: DataFrame, groups: Sequence[str], affinity: Column, hand: Column, contact: Column, least: float = 0.25, ratio: float = HAND_RATIO, cell: float = 64.0) -> DataFrame:
    """Labelled boxes and parts one to one: box_id, part_id, share, affinity, round.

    As ``best_overlaps``, but a box labelled as a hand takes only points of contact, which must also overlap it by the
    ratio of intersection to union, other boxes take only other parts, and no part is taken twice: the pair of highest
    affinity goes first, then of the largest share, then of the smallest box and part. A round takes all pairs that are
    the best of both their box and their part, which are those that taking one after the other takes; what is left of
    the others goes into the next round, and each group settles at least one pair a round.
    """
    b, p = [F.col(f"b{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"p{c}") for c in ("x1", "y1", "x2", "y2")]
    fits = (hand == contact) & (~hand | (overlap_ratio(b, p) >= ratio))
    left = _met(boxes, parts, groups, cell).where(fits & (F.col("share") >= least)).select(*groups, "box_id", "part_id", "share", affinity.alias("affinity"))
    left = stored(left, "candidates")
    order = (F.desc("affinity"), F.desc("share"), "box_id", "part_id")
    found, n = None, 0
    while True:
        n += 1
        first = lambda c: F.row_number().over(W.partitionBy(*groups, c).orderBy(*order)) == 1
        marked = left.withColumn("_b", first("box_id")).withColumn("_p", first("part_id"))
        taken = stored(marked.where("_b AND _p").select(*groups, "box_id", "part_id", "share", "affinity", F.lit(n).alias("round")), "pairs")
        found = taken if found is None else found.unionByName(taken)
        if not taken.head(1):
            return found
        rest = left.join(taken.select(*groups, "box_id"), [*groups, "box_id"], "left_anti").join(taken.select(*groups, "part_id"), [*groups, "part_id"], "left_anti")
        last, left = left, stored(rest.select(left.columns), "candidates")
        dropped(last)


def grid_step(cell: Column, source_width: Column) -> Column:
    """The 1-2-5 step that is at least a fifth of a cell in source pixels."""
    want = F.greatest(F.lit(1.0), F.greatest(F.lit(1), source_width) / F.greatest(F.lit(1), cell) * cell / 5)
    base = F.pow(F.lit(10.0), F.floor(F.log10(want)))
    return F.when(base >= want, base).when(base * 2 >= want, base * 2).when(base * 5 >= want, base * 5).otherwise(base * 10)


def grid_ticks(views: DataFrame, low: str, high: str, step: Column) -> DataFrame:
    """views with tick: the multiples of the step from low to high, both inclusive."""
    first, last = F.ceil(F.col(low) / F.col("_step")).cast("long"), F.floor(F.col(high) / F.col("_step")).cast("long")
    ticks = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))
    return views.withColumn("_step", step.cast("double")).withColumn("_k", F.explode(ticks)).withColumn("tick", F.col("_k") * F.col("_step")).drop("_k", "_step")


def named_cells(views: DataFrame, cells: str) -> DataFrame:
    """views (x, y, width, height, columns, rows, and an array of names such as B3) -> views with cell, x1, y1, x2, y2 of
    each named cell; names that the grid hasn't got are left out."""
    each = views.withColumn("cell", F.explode(cells)).withColumn("cell", F.upper(F.trim("cell"))).where(F.col("cell").rlike("^[A-Z][0-9]+$"))
    column, row = F.ascii("cell") - 65, F.substr("cell", F.lit(2)).try_cast("int")
    inside = each.withColumn("_c", column).withColumn("_r", row).where((F.col("_c") < F.col("columns")) & F.col("_r").between(1, F.col("rows")))
    edge = lambda start, k, size, n: F.col(start) + k * F.col(size) / F.col(n)
    c, r = F.col("_c"), F.col("_r")
    return inside.withColumns({"x1": edge("x", c, "width", "columns"), "x2": edge("x", c + 1, "width", "columns"), "y1": edge("y", r - 1, "height", "rows"), "y2": edge("y", r, "height", "rows")}).drop("_c", "_r")


def cell_union(named: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The box around each group's cells, and the median of their centres (mid_x, mid_y)."""
    mid = lambda a, b: F.median((F.col(a) + F.col(b)) / 2)
    return named.groupBy(*groups).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), mid("x1", "x2").alias("mid_x"), mid("y1", "y2").alias("mid_y"))


def integer_crop(box: Sequence[Column]) -> Column:
    """Struct (x, y, width, height): the smallest whole pixels around a box."""
    x, y = F.floor(box[0]).cast("long"), F.floor(box[1]).cast("long")
    size = lambda high, low: F.greatest(F.lit(0).cast("long"), F.ceil(high).cast("long") - low)
    return F.struct(x.alias("x"), y.alias("y"), size(box[2], x).alias("width"), size(box[3], y).alias("height"))


def derived_point(box: Sequence[Column], mode: Column) -> Column:
    """Struct (x, y): the middle of a box, or of the side that the mode names (bottom_center, top_center, left_center,
    right_center)."""
    x = F.when(mode == "left_center", box[0]).when(mode == "right_center", box[2]).otherwise((box[0] + box[2]) / 2)
    y = F.when(mode == "top_center", box[1]).when(mode == "bottom_center", box[3]).otherwise((box[1] + box[3]) / 2)
    return F.struct(x.alias("x"), y.alias("y"))


def transformed_bounds(box: Sequence[Column], scale: Sequence[Column], degrees: Column, offset: Sequence[Column]) -> Column:
    """Struct (x1, y1, x2, y2): bounds of a box that is scaled, turned about the origin and moved."""
    sin, cos = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    corners = [(box[i] * scale[0], box[j] * scale[1]) for i in (0, 2) for j in (1, 3)]
    xs, ys = [x * cos - y * sin for x, y in corners], [x * sin + y * cos for x, y in corners]
    return F.struct((F.least(*xs) + offset[0]).alias("x1"), (F.least(*ys) + offset[1]).alias("y1"), (F.greatest(*xs) + offset[0]).alias("x2"), (F.greatest(*ys) + offset[1]).alias("y2"))
