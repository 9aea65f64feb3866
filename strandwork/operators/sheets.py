"""Sheets of cells: packings from requests and sidecars, cells as rows, and numbered slots; and how steady parts stay.

A sheet's cells are generated from its own row; nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Packing columns of a request or sidecar.
PACKING = ("columns", "rows", "cell_w", "cell_h", "pad")


def packings(requests: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """requests (key, width, height, packing columns, div_columns, div_rows) with the packing to slice a sheet by, and problem.

    A sidecar (key, packing columns) fills a request that names neither columns, rows, cells nor divisions; a missing pad
    is the sidecar's then, else 0. Divisions that differ from the sidecar's grid are a problem ("packing mismatch") where
    nothing else is named. Missing counts are those that fit the cell; a missing cell size is what the counts leave.
    Other problems: "no grid" and "does not fit". A sheet with a problem has no packing. One sidecar a sheet is assumed.
    """
    side = sidecars.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in PACKING], F.lit(True).alias("_there"))
    r = requests.join(side, key, "left")
    cell = F.coalesce("cell_w", "cell_h").isNotNull()
    counts = F.coalesce("columns", "rows").isNotNull()
    divided = F.col("div_columns").isNotNull()
    fill = F.col("_there").isNotNull() & ~counts & ~cell & ~divided
    mismatch = F.col("_there").isNotNull() & divided & ~counts & ~cell & ((F.col("div_columns") != F.col("_columns")) | (F.col("div_rows") != F.col("_rows")))
    pick = lambda c, div=None: F.when(fill, F.col(f"_{c}")).otherwise(F.coalesce(F.col(c), *([F.col(div)] if div else [])))
    r = r.withColumn("_p", F.coalesce(F.col("pad"), F.when(fill, F.col("_pad")), F.lit(0)))
    r = r.withColumn("_w", F.coalesce(pick("cell_w"), pick("cell_h"))).withColumn("_h", F.coalesce(pick("cell_h"), pick("cell_w")))
    fitting = lambda size, c: F.floor((F.col(size) + F.col("_p")) / (F.col(c) + F.col("_p")))
    r = r.withColumn("_c", F.coalesce(pick("columns", "div_columns"), fitting("width", "_w"))).withColumn("_r", F.coalesce(pick("rows", "div_rows"), fitting("height", "_h")))
    left = lambda size, n: F.floor((F.col(size) - F.col("_p") * F.greatest(F.col(n) - 1, F.lit(0))) / F.when(F.col(n) > 0, F.col(n)))
    r = r.withColumn("_w", F.coalesce("_w", left("width", "_c"))).withColumn("_h", F.coalesce("_h", left("height", "_r")))
    need = lambda n, size: F.col(n) * F.col(size) + (F.col(n) - 1) * F.col("_p")
    bad = (F.least("_c", "_r", "_w", "_h") <= 0) | (need("_c", "_w") > F.col("width")) | (need("_r", "_h") > F.col("height"))
    none = F.col("_c").isNull() | F.col("_r").isNull()
    r = r.withColumn("problem", F.when(mismatch, "packing mismatch").when(none, "no grid").when(F.coalesce(bad, F.lit(True)), "does not fit"))
    ok = F.col("problem").isNull()
    return r.select(key, *[F.when(ok, F.col(v)).cast("long").alias(c) for c, v in zip(PACKING, ("_c", "_r", "_w", "_h", "_p"), strict=True)], "problem")


def cells(sheets: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row a cell of each packed sheet, row by row: keep, frame_index and the cell's x, y, width, height."""
    n = F.col("columns") * F.col("rows")
    every = sheets.where("columns IS NOT NULL").select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("frame_index"))
    at = lambda place, size: (place * (F.col(size) + F.col("pad"))).cast("long")
    x, y = at(F.col("frame_index") % F.col("columns"), "cell_w"), at(F.floor(F.col("frame_index") / F.col("columns")), "cell_h")
    return every.select(*keep, "frame_index", x.alias("x"), y.alias("y"), F.col("cell_w").alias("width"), F.col("cell_h").alias("height"))


def sheet_frames(px: DataFrame, packings: DataFrame, key: str, start: int = 0, skip_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """px (key, x, y, r, g, b, a) of sheets cut by their packings -> the frames' pixels (key, frame_index, x, y, r, g, b,
    a, from their own corner), and the cells (key, cell, frame_index; null for those left out).

    A pixel's cell follows from its place, and pixels of pads belong to none, so that cells and pixels meet by equality.
    Cells without a pixel that has any alpha are left out, and the others numbered from ``start`` in reading order;
    numbering needs one row a cell. Sheets without a packing have no frames.
    """
    packed = px.join(packings.where("columns IS NOT NULL").select(key, "columns", "rows", "cell_w", "cell_h", "pad"), key)
    x, y, w, h = F.col("x"), F.col("y"), F.col("cell_w") + F.col("pad"), F.col("cell_h") + F.col("pad")
    column, row = F.floor(x / w), F.floor(y / h)
    inside = (column < F.col("columns")) & (row < F.col("rows")) & (x % w < F.col("cell_w")) & (y % h < F.col("cell_h"))
    cut = packed.where(inside).select(key, (row * F.col("columns") + column).cast("long").alias("cell"), (x % w).cast("long").alias("x"), (y % h).cast("long").alias("y"), "r", "g", "b", "a")
    every = cells(packings, [key]).select(key, F.col("frame_index").alias("cell"))
    full = cut.groupBy(key, "cell").agg(F.max(F.col("a") != 0).alias("_full"))
    known = every.join(full, [key, "cell"], "left").withColumn("_full", F.coalesce("_full", F.lit(False)) | F.lit(not skip_empty))
    number = F.sum(F.col("_full").cast("long")).over(W.partitionBy(key).orderBy("cell")) - 1 + start
    numbered = known.select(key, "cell", F.when(F.col("_full"), number).alias("frame_index"))
    frames = cut.join(numbered.where("frame_index IS NOT NULL"), [key, "cell"]).select(key, "frame_index", "x", "y", "r", "g", "b", "a")
    return frames, numbered


def slots(frames: DataFrame, keep: Sequence[str], start: Column, end: Column) -> DataFrame:
    """The frames from start to end (inclusive) with the names of their copies, numbered from the range's start."""
    i = F.col("frame_index")
    return frames.where((i >= start) & (i <= end)).select(*keep, "frame_index", F.concat((i - start).cast("string"), F.lit(".png")).alias("copy_name"))


def steadiness(found: DataFrame, clips: DataFrame, groups: Sequence[str], centre: str, area: str) -> DataFrame:
    """How steady a part stays over a clip's frames: the share of frames that have it, less twice the mean deviation of
    its centre (a share of the width) and the relative mean deviation of its area, in [0, 1]. Clips with one find are left out. clips: groups and their number of frames.

    centre and area are whole numbers (centre in thousandths), so that sums don't depend on their order: a deviation from
    a mean is that of n times the value from the sum.
    """
    sums = found.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(centre).alias("_c"), F.sum(area).alias("_a")).where("n > 1").join(clips.select(*groups, "frames"), list(groups))
    off = lambda v, s: F.sum(F.abs(F.col(v) * F.col("n") - F.col(s)))
    drift = found.join(sums, list(groups)).groupBy(*groups, "frames", "n", "_a").agg(off(centre, "_c").alias("_dc"), off(area, "_a").alias("_da"))
    n2 = (F.col("n") * F.col("n")).cast("double")
    score = F.col("n") / F.col("frames") - 2 * (F.col("_dc") / (n2 * 1000)) - F.col("_da") / F.greatest(F.lit(1.0), F.col("n") * F.col("_a").cast("double"))
    return drift.select(*groups, "n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))


def contact_cells(frames: DataFrame, groups: Sequence[str], columns: int = 8, cell: int = 220, pad: int = 8) -> DataFrame:
    """frames (groups, frame_index from 0) with their cell on a sheet of the group: column, row, x, y of its corner, and
    sheet_width and sheet_height. A short sheet has as many columns as frames."""
    n = F.count("*").over(W.partitionBy(*groups))
    wide = F.least(n, F.lit(columns))
    i = F.col("frame_index")
    at = lambda k: (pad + k * (cell + pad)).cast("long")
    size = lambda k: (k * cell + (k + 1) * pad).cast("long")
    out = frames.withColumn("column", (i % wide).cast("long")).withColumn("row", F.floor(i / wide).cast("long"))
    out = out.withColumn("sheet_width", size(wide)).withColumn("sheet_height", size(F.ceil(n / wide)))
    return out.withColumn("x", at(F.col("column"))).withColumn("y", at(F.col("row")))


def contact_pixels(px: DataFrame, placed: DataFrame, groups: Sequence[str], width: int, height: int, cell: int, least: int = 16, light: int = 200, dark: int = 150) -> DataFrame:
    """Pixels of contact sheets: each frame's cell sampled from its nearest pixels, over a chequered ground of 4 x 4.

    px: groups, frame_index, x, y, r, g, b, a; placed: as ``contact_cells`` gives it. Cells generate their own pixels, and
    these name the source pixel that they show, so both meet by equality.
    """
    side = F.sequence(F.lit(0), F.lit(cell - 1))
    every = placed.select(*groups, "frame_index", F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(side).alias("_i")).withColumn("_j", F.explode(side))
    source = lambda k, size: F.least(F.lit(size - 1), F.floor((F.col(k) + 0.5) * size / cell)).cast("long")
    asked = every.select(*groups, "frame_index", (F.col("_x") + F.col("_i")).alias("sheet_x"), (F.col("_y") + F.col("_j")).alias("sheet_y"), source("_i", width).alias("x"), source("_j", height).alias("y"), ((F.floor(F.col("_i") / 4) + F.floor(F.col("_j") / 4)) % 2).alias("_odd"))
    shown = px.where(F.col("a") > least).select(*groups, "frame_index", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "r", "g", "b")
    ground = F.when(F.col("_odd") == 0, light).otherwise(dark)
    return asked.join(shown, [*groups, "frame_index", "x", "y"], "left").select(*groups, "frame_index", "sheet_x", "sheet_y", *[F.coalesce(c, ground).cast("int").alias(c) for c in "rgb"])
