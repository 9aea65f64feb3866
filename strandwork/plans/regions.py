"""Registered queries over regions of images; an embedding of 64 numbers is read as an image of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandwork.operators import clips, rasters, regions
from strandwork.plans.catalog import registered
from strandwork.plans.rasters import PX, SIDE, I, pixels

#: Each pixel of a region with the region's first pixel, by a walk from every pixel to all that it reaches.
REGION = """{name} AS (
  SELECT image_id, p, min(q) AS first FROM {name}_reach GROUP BY image_id, p),"""
REACH = """{name}_in AS (SELECT image_id, y * 8 + x AS p, x, y FROM px WHERE {seen}),
{name}_step AS (SELECT a.image_id, a.p, b.p AS q FROM {name}_in a JOIN {name}_in b ON a.image_id = b.image_id AND {beside}),
{name}_reach AS (SELECT image_id, p, p AS q FROM {name}_in UNION SELECT r.image_id, r.p, s.q FROM {name}_reach r JOIN {name}_step s ON s.image_id = r.image_id AND s.p = r.q),"""
CORNERS = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1"
SIDES = "abs(a.x - b.x) + abs(a.y - b.y) = 1"

HOLES = (REACH + REGION).format(name="clear", seen="a <= 8", beside=SIDES) + """
hole AS (SELECT image_id, first, count(*) AS n FROM clear GROUP BY ALL HAVING NOT bool_or(p % 8 IN (0, 7) OR p // 8 IN (0, 7))),
holes AS (SELECT i.image_id, count(first) AS holes, coalesce(sum(n), 0)::BIGINT AS hole_pixels FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN hole h ON h.image_id = i.image_id GROUP BY ALL)"""


@registered("part_statistics", f"""WITH RECURSIVE {PX}, {(REACH + REGION).format(name="seen", seen="a > 128", beside=CORNERS)}
s AS (
  SELECT px.image_id, first, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS n, sum(a)::BIGINT AS m, sum(x * a)::DOUBLE / sum(a) AS cx, sum(y * a)::DOUBLE / sum(a) AS cy,
         sum(x * x * a)::DOUBLE / sum(a) AS xx, sum(x * y * a)::DOUBLE / sum(a) AS xy, sum(y * y * a)::DOUBLE / sum(a) AS yy, sum((r * 2126 + g * 7152 + b * 722) * a)::DOUBLE / sum(a) / 10000 AS luma,
         sum((greatest(r, g, b) - least(r, g, b)) * a)::DOUBLE / sum(a) AS chroma, count(*) FILTER (x IN (0, 7) OR y IN (0, 7)) AS edge
  FROM seen JOIN px ON px.image_id = seen.image_id AND px.y * 8 + px.x = seen.p GROUP BY ALL),
v AS (SELECT *, greatest(0, xx - cx * cx) AS vx, greatest(0, yy - cy * cy) AS vy, xy - cx * cy AS vxy, max_x - min_x + 1 AS w, max_y - min_y + 1 AS h FROM s),
e AS (SELECT *, sqrt((vx - vy) * (vx - vy) + 4 * vxy * vxy) AS root FROM v)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY first) - 1 AS part_id, min_x, min_y, max_x, max_y, n AS count, m AS alpha, floor(cx * 1000 + 0.5)::BIGINT AS centre_x_milli,
       floor(cy * 1000 + 0.5)::BIGINT AS centre_y_milli, floor(n / (w * h) * 1000 + 0.5)::BIGINT AS fill_milli, floor(greatest(w, h) / least(w, h) * 1000 + 0.5)::BIGINT AS aspect_milli,
       floor(greatest(0, (vx + vy + root) / 2) / greatest(1e-6, (vx + vy - root) / 2) * 1000 + 0.5)::BIGINT AS spread_milli, floor(luma * 1000 + 0.5)::BIGINT AS luma_milli,
       floor(chroma * 1000 + 0.5)::BIGINT AS chroma_milli, floor(edge / n * 1000 + 0.5)::BIGINT AS border_milli, n < 4 AS noise
FROM e""")
def part_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.part_statistics(pixels(spark, sf_dir), I, SIDE, SIDE, 128)


@registered("alpha_holes", f"""WITH RECURSIVE {PX}, {HOLES} SELECT * FROM holes""")
def alpha_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.holes(pixels(spark, sf_dir), I, SIDE, SIDE)


@registered("image_quality", f"""WITH RECURSIVE {PX}, {HOLES},
edge AS (SELECT p.*, p.x IN (0, 7) OR p.y IN (0, 7) AS border,
        EXISTS (SELECT 1 FROM px q WHERE q.image_id = p.image_id AND q.a <= 8 AND abs(q.x - p.x) + abs(q.y - p.y) = 1) AS beside FROM px p WHERE p.a > 8),
ev AS (SELECT image_id, count(*) FILTER (border OR beside) AS edges, count(*) FILTER ((border OR beside) AND least(r, g, b) >= 220 AND greatest(r, g, b) - least(r, g, b) < 30) AS white,
              count(*) FILTER (border) AS boundary FROM edge GROUP BY image_id),
box AS (SELECT label, image_id, row_number() OVER (PARTITION BY label ORDER BY image_id) - 1 AS frame_index, max(y) FILTER (a > 16) AS feet,
               coalesce(max(y) FILTER (a > 16) - min(y) FILTER (a > 16) + 1, 0) AS tall, max(x) FILTER (a > 16) + min(x) FILTER (a > 16) AS centre FROM px GROUP BY label, image_id),
m AS (SELECT * FROM box JOIN holes USING (image_id) LEFT JOIN ev USING (image_id)),
r AS (SELECT label, list_sort(list(tall))[count(*) // 2 + 1] AS rb, list_sort(list(feet))[count(*) // 2 + 1] AS rf, list_sort(list(centre))[count(*) // 2 + 1] AS rc FROM m GROUP BY label)
SELECT label, frame_index, holes, hole_pixels, concat_ws(',', CASE WHEN tall = 0 THEN 'empty' END, CASE WHEN rb > 0 AND abs(tall - rb) / rb > 0.2 THEN 'size_jump' END,
         CASE WHEN abs(feet - rf) > 3 THEN 'feet_drift' END, CASE WHEN abs(centre - rc) > 5 THEN 'center_drift' END, CASE WHEN hole_pixels >= 4 THEN 'alpha_holes' END,
         CASE WHEN white >= 4 AND white / greatest(edges, 1) > 0.25 THEN 'bright_edge' END, CASE WHEN boundary > 0 THEN 'touches_canvas_edge' END) AS issues
FROM m JOIN r USING (label)""")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's images as a clip, judged by their pixels: boxes, edges and holes."""
    px = pixels(spark, sf_dir)
    box = rasters.bounds(px, ["label", *I]).select("label", *I, F.col("max_y").alias("feet"), F.coalesce(F.col("max_y") - F.col("min_y") + 1, F.lit(0)).alias("tall"), (F.col("max_x") + F.col("min_x")).alias("centre"))
    box = box.withColumn("frame_index", F.row_number().over(W.partitionBy("label").orderBy(*I)).cast("long") - 1)
    found = box.hint("merge").join(regions.holes(px, I, SIDE, SIDE), I).hint("merge").join(rasters.edge_evidence(px, I, SIDE, SIDE), I, "left")
    issues = clips.quality_issues(found.withColumn("box_height", F.col("tall")).withColumn("body_height", F.col("tall")), ["label"])
    return issues.select("label", "frame_index", "holes", "hole_pixels", F.array_join("issues", ",").alias("issues"))


@registered("thickness_profile", f"""WITH {PX},
s AS (SELECT image_id, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(x * y)::BIGINT AS sxy, sum(y * y)::BIGINT AS syy, max(x) - min(x) AS wide, max(y) - min(y) AS high
      FROM px WHERE a > 16 GROUP BY image_id HAVING count(*) >= 8),
m AS (SELECT image_id, wide, high, sx / n AS mx, sy / n AS my, (n * sxx - sx * sx) / n AS xx, (n * sxy - sx * sy) / n AS xy, (n * syy - sy * sy) / n AS yy FROM s),
d AS (SELECT *, (xx + yy) / 2 + sqrt(greatest(0, (xx + yy) / 2 * ((xx + yy) / 2) - (xx * yy - xy * xy))) - yy AS along,
             CASE WHEN abs(xy) <= 0.15::DOUBLE * greatest(xx, yy, 1) AND high >= wide * 1.15::DOUBLE THEN 'up' WHEN abs(xy) <= 0.15::DOUBLE * greatest(xx, yy, 1) AND wide >= high * 1.15::DOUBLE THEN 'level'
                  WHEN xy = 0 AND xx >= yy THEN 'level' WHEN xy = 0 THEN 'up' ELSE 'own' END AS way FROM m),
ax AS (SELECT image_id, mx, my, CASE way WHEN 'up' THEN 0::DOUBLE WHEN 'level' THEN 1::DOUBLE ELSE along / sqrt(along * along + xy * xy) END AS ax, CASE way WHEN 'up' THEN 1::DOUBLE WHEN 'level' THEN 0::DOUBLE ELSE xy / sqrt(along * along + xy * xy) END AS ay FROM d),
p AS (SELECT image_id, (x - mx) * ax + (y - my) * ay AS along, (y - my) * ax - (x - mx) * ay AS across FROM px JOIN ax USING (image_id) WHERE a > 16),
e AS (SELECT image_id, min(along) AS low, greatest(0.0001::DOUBLE, max(along) - min(along)) AS span FROM p GROUP BY image_id),
b AS (SELECT image_id, least(23, greatest(0, floor((along - low) / span * 24)))::BIGINT AS bin, count(*) AS pixels, floor((max(across) - min(across)) * 1000 + 0.5)::BIGINT AS t FROM p JOIN e USING (image_id) GROUP BY ALL),
g AS (SELECT image_id, unnest(range(0, 24)) AS bin FROM e)
SELECT image_id, bin, coalesce(pixels, 0) AS pixels, t AS thickness_milli, row_number() OVER (PARTITION BY image_id ORDER BY t DESC NULLS LAST, bin) = 1 AS widest FROM g LEFT JOIN b USING (image_id, bin)""")
def thickness_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.thickness(pixels(spark, sf_dir), I)
