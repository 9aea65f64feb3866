"""Registered queries that plant, register, trim and pad frames on their canvases, with their pixels and points; each with
its SQL. A label's images are a clip; their canvases differ by their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.operators import canvases, manifests
from strandwork.plans.catalog import registered
from strandwork.plans.rasters import PX, I, pixels
from strandwork.session import table

CLIP = ["label"]

#: A frame's pixels on a canvas of six or eight by six to eight; its sole is the lowest row with a pixel of alpha above 100.
GEO = f"""{PX},
n AS (SELECT image_id, row_number() OVER (PARTITION BY label ORDER BY image_id) - 1 AS frame_index FROM (SELECT DISTINCT image_id, label FROM px)),
p AS (SELECT px.*, frame_index, 8 - px.image_id % 2 * 2 AS width, 8 - px.image_id % 3 AS height FROM px JOIN n USING (image_id) WHERE x < 8 - px.image_id % 2 * 2 AND y < 8 - px.image_id % 3),
b AS (SELECT image_id, label, frame_index, width, height, coalesce(min(x) FILTER (a > 16), 0) AS min_x, coalesce(min(y) FILTER (a > 16), 0) AS min_y, coalesce(max(x) FILTER (a > 16), 0) AS max_x, coalesce(max(y) FILTER (a > 16), 0) AS max_y,
             count(*) FILTER (a > 16) AS opaque, coalesce(max(y) FILTER (a > 100), max(y) FILTER (a > 16), 0) AS feet_y FROM p GROUP BY ALL),
geo AS (SELECT *, (min_x + max_x) / 2 AS cx, CASE WHEN opaque = 0 THEN 0 ELSE feet_y - min_y + 1 END AS body_height FROM b)"""

PLANT = """dy AS (SELECT *, feet_goal - (feet_y - (height - CASE WHEN max_y = height - 1 THEN max_y - feet_y ELSE 0 END)) AS dy FROM (SELECT *, -1 - image_id % 4 AS feet_goal FROM geo)),
plan AS (SELECT *, greatest(height, max_y + dy + 1) AS out_height FROM dy)"""

REGISTER = """f AS (SELECT *, CASE WHEN body_height > 0 THEN body_height ELSE max_y - min_y + 1 END AS tall FROM geo),
v AS (SELECT label, cx AS dest_x, feet_y AS dest_y, tall AS pivot_tall FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY CASE WHEN frame_index <= 2 THEN -frame_index ELSE frame_index END) = 1),
plan AS (SELECT f.*, dest_x, dest_y, floor((6 + label % 5) / greatest(1, CASE WHEN label % 3 = 0 THEN pivot_tall ELSE tall END) * 10000 + 0.5) / 10000 AS scale FROM f JOIN v USING (label))"""


def left():
    """Labels with odd numbers are anchored at the lower left corner."""
    return F.col("label") % 2 == 1


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label").distinct()


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_id")
    return pixels(spark, sf_dir).withColumn("width", 8 - i % 2 * 2).withColumn("height", 8 - i % 3).where("x < width AND y < height")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = framed(spark, sf_dir)
    soles = px.where("a > 100").groupBy(*I).agg(F.max("y").alias("sole_y"))
    frames = images(spark, sf_dir).withColumn("frame_index", F.row_number().over(W.partitionBy(*CLIP).orderBy(*I)).cast("long") - 1)
    i = F.col("image_id")
    return canvases.geometry(px, soles, I).join(frames.withColumn("width", 8 - i % 2 * 2).withColumn("height", 8 - i % 3), I)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvases.plant_plan(measured(spark, sf_dir), -1 - F.col("image_id") % 4)


def clip_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvases.register_plan(measured(spark, sf_dir), CLIP, 6 + F.col("label") % 5, 2, F.col("label") % 3 != 0)


@registered("frame_geometry", f"""WITH {GEO},
s AS (SELECT image_id, avg(x) AS fx FROM p JOIN (SELECT image_id, feet_y FROM geo) USING (image_id) WHERE y = feet_y AND a > 16 GROUP BY image_id)
SELECT image_id, label, frame_index, width, height, min_x, min_y, max_x, max_y, opaque, feet_y, body_height, (cx * 2)::BIGINT AS cx_x2, floor(coalesce(fx, cx) * 1000 + 0.5)::BIGINT AS fx_milli FROM geo LEFT JOIN s USING (image_id)""")
def frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = measured(spark, sf_dir)
    return g.withColumn("cx_x2", (F.col("cx") * 2).cast("long")).withColumn("fx_milli", F.floor(F.col("fx") * 1000 + 0.5).cast("long")).drop("cx", "fx")


@registered("planted_feet", f"WITH {GEO}, {PLANT} SELECT image_id, feet_y, dy::BIGINT AS dy, out_height::BIGINT AS out_height FROM plan")
def planted_feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir).select("image_id", "feet_y", "dy", "out_height")


@registered("planted_pixels", f"WITH {GEO}, {PLANT} SELECT image_id, x, (y + dy)::BIGINT AS y, k AS ink FROM p JOIN (SELECT image_id, dy, out_height FROM plan) USING (image_id) WHERE y + dy BETWEEN 0 AND out_height - 1")
def planted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = framed(spark, sf_dir).select("image_id", "x", "y", F.col("k").alias("ink"))
    return canvases.moved(px, planted(spark, sf_dir), I)


@registered("registered_clips", f"""WITH {GEO}, {REGISTER}
SELECT image_id, label, floor(scale * 10000 + 0.5)::BIGINT AS scale_x10000, (cx * 2)::BIGINT AS source_x2, (dest_x * 2)::BIGINT AS dest_x2, feet_y AS source_y, dest_y FROM plan""")
def registered_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's frames scaled to a height, by their own scale or the third frame's."""
    whole = lambda c, by, name: F.floor(F.col(c) * by + 0.5).cast("long").alias(name)
    return clip_plan(spark, sf_dir).select(
        "image_id", "label", whole("scale", 10000, "scale_x10000"), whole("source_x", 2, "source_x2"), whole("dest_x", 2, "dest_x2"), whole("source_y", 1, "source_y"), whole("dest_y", 1, "dest_y")
    )


@registered("registered_pixels", f"""WITH {GEO}, {REGISTER},
g AS (SELECT image_id, i AS x, j AS y, floor(cx + (i - dest_x) / scale + 0.5) AS old_x, floor(feet_y + (j - dest_y) / scale + 0.5) AS old_y FROM (SELECT *, unnest(range(width)) AS i FROM plan), range(8) AS r(j) WHERE j < height)
SELECT g.image_id, g.x, g.y, k AS ink FROM g JOIN p ON p.image_id = g.image_id AND p.x = old_x AND p.y = old_y WHERE a > 16""")
def registered_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their pixels: SQL looks each new place up, the operator sends each old pixel to its places."""
    px = framed(spark, sf_dir).select("image_id", "x", "y", "a", F.col("k").alias("ink"))
    return canvases.scaled(px, clip_plan(spark, sf_dir), I).drop("a")


TRIM = """o AS (SELECT *, CASE WHEN label % 2 = 1 THEN 0 ELSE width / 2 END AS ax, label % 3 > 0 AS keep FROM geo),
t AS (SELECT label, min(min_x - ax) - 1 AS x1, min(min_y - height) - 1 AS y1, max(max_x + 1 - ax) + 1 AS x2, max(max_y + 1 - height) + 1 AS y2 FROM o WHERE opaque > 0 GROUP BY label),
w AS (SELECT o.*, x1, y1, CASE WHEN keep AND label % 2 = 1 THEN ceil(x2) WHEN keep THEN ceil(greatest(-x1, x2)) * 2 ELSE ceil(x2 - x1) END AS w, CASE WHEN keep THEN ceil(-y1) ELSE ceil(y2 - y1) END AS h FROM o LEFT JOIN t USING (label)),
m AS (SELECT *, -CASE WHEN keep AND label % 2 = 1 THEN 0 WHEN keep THEN -w / 2 ELSE x1 END - ax AS raw_x, -CASE WHEN keep THEN -h ELSE y1 END - height AS raw_y, CASE WHEN label % 2 = 1 THEN 0 ELSE w / 2 END AS new_ax FROM w),
plan AS (SELECT *, floor(raw_x + 0.5) AS dx, floor(raw_y + 0.5) AS dy FROM m)"""


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvases.trim_plan(measured(spark, sf_dir), CLIP, left(), F.col("label") % 3 > 0, 1)


@registered("trimmed_canvases", f"""WITH {GEO}, {TRIM}
SELECT image_id, w::BIGINT AS out_width, h::BIGINT AS out_height, dx::BIGINT AS dx, dy::BIGINT AS dy, raw_x = dx AND raw_y = dy AS exact, ((ax + dx - new_ax) * 2)::BIGINT AS shift_x2, (height + dy - h)::BIGINT AS shift_y, w BETWEEN 1 AND 4096 AND h BETWEEN 1 AND 4096 AS fits FROM plan""")
def trimmed_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trimmed(spark, sf_dir).select("image_id", "out_width", "out_height", "dx", "dy", "exact", (F.col("shift_x") * 2).cast("long").alias("shift_x2"), F.col("shift_y").cast("long").alias("shift_y"), "fits")


@registered("padded_canvases", f"""WITH {GEO}, o AS (SELECT *, 5 + image_id % 7 AS w, 6 + image_id % 4 AS h FROM geo),
m AS (SELECT *, CASE WHEN label % 2 = 1 THEN 0 ELSE w / 2 - width / 2 END AS raw_x, h - height AS dy FROM o), d AS (SELECT *, floor(raw_x + 0.5) AS dx FROM m)
SELECT image_id, w AS out_width, h AS out_height, dx::BIGINT AS dx, dy, raw_x = dx AS exact, count(*) FILTER (a > 0 AND (x + dx < 0 OR x + dx >= w OR y + dy < 0 OR y + dy >= h)) AS clipped FROM d JOIN (SELECT image_id, x, y, a FROM p) USING (image_id) GROUP BY ALL""")
def padded_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvases of given sizes about the same anchors, and the pixels that fall off."""
    i = F.col("image_id")
    plan = canvases.pad_plan(measured(spark, sf_dir), 5 + i % 7, 6 + i % 4, left())
    return plan.select("image_id", "out_width", "out_height", "dx", "dy", "exact").join(canvases.clipped(framed(spark, sf_dir), plan, I), I)


@registered("resized_points", f"""WITH {GEO}, {TRIM}, q AS (SELECT vec_id AS image_id, unnest([0, 1, 2]) AS point FROM embeddings)
SELECT q.image_id, point, (point * 5 * 2 + coalesce((ax + dx - new_ax) * 2, 0))::BIGINT AS x2, (-point * 3 + coalesce(height + dy - h, 0))::BIGINT AS y FROM q LEFT JOIN plan ON plan.image_id = q.image_id AND q.point < 3""")
def resized_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points a frame, moved with their frames' trimmed canvases."""
    shifts = trimmed(spark, sf_dir).select("image_id", F.col("shift_x").alias("dx"), F.col("shift_y").alias("dy"))
    points = images(spark, sf_dir).select("image_id", F.explode(F.array(*map(F.lit, range(3)))).alias("point"))
    points = points.withColumn("x", F.col("point") * 5.0).withColumn("y", -F.col("point") * 3)
    out = manifests.shift_points(points, shifts, I, ["x"], ["y"])
    return out.select("image_id", "point", (F.col("x") * 2).cast("long").alias("x2"), F.col("y").cast("long").alias("y"))
