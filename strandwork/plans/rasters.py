"""Registered queries over pixel tables: an embedding of 64 numbers is read as an image of 8 by 8 pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import rasters
from strandwork.plans.catalog import registered
from strandwork.session import table

I = ["image_id"]  # noqa: E741
SIDE = 8

PX = """k AS (
  SELECT vec_id AS image_id, label, (i - 1) % 8 AS x, (i - 1) // 8 AS y, cast(floor(abs(v::DOUBLE) * 1000) AS BIGINT) AS k
  FROM (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings)),
px AS (
  SELECT image_id, label, x, y, k, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 256 END AS a,
         (k * 7) % 256 AS r, (k * 13) % 256 AS g, (k * 29) % 256 AS b
  FROM k)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("i", "v"))
    e = e.select("image_id", "label", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.floor(F.abs(F.col("v").cast("double")) * 1000).alias("k"))
    channel = lambda n: (F.col("k") * n % 256).cast("int")
    return e.select("*", F.when(F.col("k") % 4 == 0, 0).otherwise(channel(1)).alias("a"), channel(7).alias("r"), channel(13).alias("g"), channel(29).alias("b"))


@registered("opaque_bounds", f"""WITH {PX}
SELECT image_id, min(x) FILTER (a > 16) AS min_x, min(y) FILTER (a > 16) AS min_y, max(x) FILTER (a > 16) AS max_x, max(y) FILTER (a > 16) AS max_y,
       count(*) FILTER (a > 16) AS opaque FROM px GROUP BY image_id""")
def opaque_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.bounds(pixels(spark, sf_dir), I)


@registered("clipped_bounds", f"""WITH {PX}, c AS (SELECT *, a > 128 AND x >= 1 AND y >= 2 AND x < 7 AND y < 6 AS seen FROM px)
SELECT image_id, min(x) FILTER (seen) AS min_x, min(y) FILTER (seen) AS min_y, max(x) FILTER (seen) AS max_x, max(y) FILTER (seen) AS max_y,
       count(*) FILTER (seen) AS opaque FROM c GROUP BY image_id""")
def clipped_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.bounds(pixels(spark, sf_dir), I, 128, (1.5, 2, 6.2, 6))


@registered("alpha_anchors", f"""WITH {PX},
v AS (SELECT *, min(y) OVER w AS high, max(y) OVER w AS low FROM px WHERE a > 16 WINDOW w AS (PARTITION BY image_id)),
s AS (SELECT *, y > low - greatest(1, floor((low - high + 1) * 0.1::DOUBLE + 0.5)) AS carries FROM v)
SELECT image_id, min(x) + max(x) + 1 AS centre_x2, min(high) + max(low) + 1 AS centre_y2, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y,
       count(*) AS opaque, max(low) + 1 AS bottom_y, min(x) FILTER (carries) + max(x) FILTER (carries) + 1 AS support_x2,
       (sum(x) FILTER (y = low))::BIGINT AS sole_sum_x, count(*) FILTER (y = low) AS sole_n
FROM s GROUP BY image_id""")
def alpha_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.anchors(pixels(spark, sf_dir), I)


@registered("pixel_counts", f"""WITH {PX}
SELECT image_id, count(*) AS pixels, count(*) FILTER (a = 0) AS transparent,
       count(*) FILTER (a > 16 AND greatest(r, g, b) <= 80 AND greatest(r, g, b) - least(r, g, b) > 12) AS dark,
       count(*) FILTER (a >= 200 AND 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b >= 240) AS near_white
FROM px GROUP BY image_id""")
def pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.pixel_counts(pixels(spark, sf_dir), I)


@registered("border_clear", f"""WITH {PX}, e AS (SELECT *, x IN (0, 7) OR y IN (0, 7) AS edge FROM px)
SELECT image_id, count(*) FILTER (a > 16) AS opaque, count(*) FILTER (edge) AS border, count(*) FILTER (edge AND a <= 16) AS clear_border
FROM e GROUP BY image_id""")
def border_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.border_clear(pixels(spark, sf_dir), I, SIDE, SIDE)


@registered("corner_means", f"""WITH {PX}, c AS (
  SELECT *, CASE WHEN x < 3 AND y < 3 THEN 0 WHEN x >= 5 AND y < 3 THEN 1 WHEN x < 3 AND y >= 5 THEN 2 WHEN x >= 5 AND y >= 5 THEN 3 END AS corner FROM px)
SELECT image_id, corner, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, count(*) AS n
FROM c WHERE corner IS NOT NULL GROUP BY image_id, corner""")
def corner_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.corner_means(pixels(spark, sf_dir), I, SIDE, SIDE, 3)


@registered("mass_bounds", f"""WITH {PX}, m AS (SELECT image_id, x, sum(a)::BIGINT AS m FROM px GROUP BY image_id, x),
r AS (SELECT image_id, x, sum(m) OVER (PARTITION BY image_id ORDER BY x) AS up, sum(m) OVER (PARTITION BY image_id) AS total FROM m)
SELECT image_id, min(x) FILTER (up::DOUBLE >= total::DOUBLE * 0.08::DOUBLE) AS low_place, min(x) FILTER (up::DOUBLE >= total::DOUBLE * 0.92::DOUBLE) AS high_place
FROM r WHERE total > 0 GROUP BY image_id""")
def mass_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.mass_bounds(pixels(spark, sf_dir), I, "x")


@registered("long_axis", f"""WITH {PX},
m AS (SELECT image_id, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS xx, sum(y * y)::BIGINT AS yy, sum(x * y)::BIGINT AS xy
      FROM px WHERE a > 16 GROUP BY image_id),
c AS (SELECT image_id, n, (n * xx - sx * sx)::DOUBLE AS a, (n * yy - sy * sy)::DOUBLE AS b, (n * xy - sx * sy)::DOUBLE AS c FROM m)
SELECT image_id, n, cast(floor(atan2(2 * c, a - b) / 2 * 1e6 + 0.5) AS BIGINT) AS angle_micro,
       cast(floor((a + b + sqrt((a - b) * (a - b) + 4 * c * c)) / 2 / (n::DOUBLE * n) * 1e3 + 0.5) AS BIGINT) AS major_milli,
       cast(floor((a + b - sqrt((a - b) * (a - b) + 4 * c * c)) / 2 / (n::DOUBLE * n) * 1e3 + 0.5) AS BIGINT) AS minor_milli
FROM c""")
def long_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.long_axis(pixels(spark, sf_dir), I)


@registered("squared_error", f"""WITH {PX},
l AS (SELECT image_id // 2 AS pair, x, y, r, g, b FROM px WHERE a > 16 AND image_id % 2 = 0),
q AS (SELECT image_id // 2 AS pair, x, y, r, g, b FROM px WHERE a > 16 AND image_id % 2 = 1)
SELECT coalesce(l.pair, q.pair) AS pair, count(*) AS pixels,
       sum((coalesce(l.r, 0) - coalesce(q.r, 0)) ** 2 + (coalesce(l.g, 0) - coalesce(q.g, 0)) ** 2 + (coalesce(l.b, 0) - coalesce(q.b, 0)) ** 2)::BIGINT AS squared
FROM l FULL JOIN q ON l.pair = q.pair AND l.x = q.x AND l.y = q.y GROUP BY 1""")
def squared_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("pair", F.floor(F.col("image_id") / 2).cast("long"))
    return rasters.squared_error(px.where("image_id % 2 = 0"), px.where("image_id % 2 = 1"), ["pair"])


@registered("hue_spread", f"""WITH {PX},
s AS (SELECT label, sum(sin(radians(k % 360))) AS s, sum(cos(radians(k % 360))) AS c, count(*) AS n FROM px GROUP BY label),
r AS (SELECT *, sqrt(pow(s / n, 2) + pow(c / n, 2)) AS length FROM s)
SELECT label, n, cast(floor((degrees(atan2(s, c)) + 360) % 360 * 1000 + 0.5) AS BIGINT) AS mean_milli,
       CASE WHEN length >= 1 THEN 0 ELSE cast(floor(degrees(sqrt(-2 * ln(length))) * 1000 + 0.5) AS BIGINT) END AS deviation_milli
FROM r""")
def hue_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.hue_spread(pixels(spark, sf_dir), ["label"], F.col("k") % 360)


@registered("body_component", """WITH p AS (
  SELECT p_brand, p_partkey AS part_id, p_size * 10 + p_partkey % 7 AS count, p_size % 13 + 1 AS width, p_partkey % 17 + 1 AS height, p_partkey % 50 AS centre_x FROM part),
t AS (SELECT *, max(count) OVER (PARTITION BY p_brand) AS top FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY height - width DESC, height DESC, abs(centre_x - 49 / 2), count DESC, part_id) AS r
      FROM t WHERE count >= top * 0.25)
SELECT p_brand, part_id, count::BIGINT AS count, width, height, centre_x FROM r WHERE r = 1""")
def body_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        "p_brand", F.col("p_partkey").alias("part_id"), (F.col("p_size") * 10 + F.col("p_partkey") % 7).alias("count"), (F.col("p_size") % 13 + 1).alias("width"),
        (F.col("p_partkey") % 17 + 1).alias("height"), (F.col("p_partkey") % 50).alias("centre_x"),
    )
    return rasters.body_component(p, ["p_brand"], 50)


@registered("edge_evidence", f"""WITH {PX},
c AS (SELECT p.*, p.x IN (0, 7) OR p.y IN (0, 7) AS border,
        EXISTS (SELECT 1 FROM px q WHERE q.image_id = p.image_id AND q.a <= 8 AND abs(q.x - p.x) + abs(q.y - p.y) = 1) AS beside FROM px p WHERE p.a > 8)
SELECT image_id, count(*) FILTER (border OR beside) AS edge_pixels,
       count(*) FILTER ((border OR beside) AND least(r, g, b) >= 220 AND greatest(r, g, b) - least(r, g, b) < 30) AS white_edge,
       count(*) FILTER (border) AS boundary FROM c GROUP BY image_id""")
def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.edge_evidence(pixels(spark, sf_dir), I, SIDE, SIDE)


@registered("sole_rows", f"""WITH {PX},
l AS (SELECT image_id, y, count(*) AS n, sum((r + g + b) // 3) AS luma, count(*) FILTER ((r + g + b) // 3 < 120) AS dark, min(x) AS first, max(x) AS last FROM px WHERE a > 100 GROUP BY ALL),
m AS (SELECT *, luma::DOUBLE / n AS mean, dark::DOUBLE / n AS share, last - first + 1 AS wide, max(dark) OVER w AS peak,
             min(y) OVER w + greatest(1, (max(y) OVER w - min(y) OVER w + 1) // 2) AS mid, max(last) OVER w - min(first) OVER w + 1 AS width FROM l WINDOW w AS (PARTITION BY image_id)),
g AS (SELECT image_id, list_sort(list(mean) FILTER (peak > 0 AND dark * 2 >= peak)) AS cores, list_sort(list(wide) FILTER (y < mid)) AS widths FROM m GROUP BY image_id),
b AS (SELECT m.*, coalesce(cores[len(cores) // 2 + 1], 0) AS core, coalesce(widths[len(widths) // 2 + 1], width) AS body FROM m JOIN g USING (image_id)),
s AS (SELECT *, NOT (mean >= greatest(core + 36, 170) AND share < 0.25) AND NOT (body > 0 AND wide >= greatest(body * 1.5, body + 6) AND share < 0.4) AS stands,
             (y > mid AND body > 0 AND wide < body * 0.55) OR (y > mid AND share < 0.65 AND mean >= core + 18) AS loose FROM b)
SELECT image_id, coalesce(max(y) FILTER (stands AND NOT loose), max(y) FILTER (stands), max(y)) AS sole_y FROM s GROUP BY image_id""")
def sole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    luma = F.floor((F.col("r") + F.col("g") + F.col("b")) / 3)
    lines = pixels(spark, sf_dir).where("a > 100").groupBy("image_id", "y").agg(
        F.count("*").alias("n"), F.sum(luma).alias("luma"), F.count(F.when(luma < 120, 1)).alias("dark"), F.min("x").alias("first"), F.max("x").alias("last")
    )
    return rasters.sole_rows(lines, I)
