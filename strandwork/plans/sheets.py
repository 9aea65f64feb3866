"""Registered queries over sheets: a part is a sheet, and some suppliers' numbers its sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import sheets
from strandwork.plans.catalog import EV, registered, user_frames
from strandwork.session import table

REQ = """q AS (
  SELECT p_partkey AS sheet, 40 + p_size AS width, 30 + p_partkey % 40 AS height,
         CASE WHEN p_partkey % 5 = 1 THEN 1 + p_partkey % 4 END AS columns, CASE WHEN p_partkey % 10 = 1 THEN 1 + p_size % 3 END AS rows,
         CASE WHEN p_partkey % 5 IN (1, 2) THEN 5 + p_size % 9 END AS cell_w, CASE WHEN p_partkey % 7 = 2 THEN 6 END AS cell_h,
         CASE WHEN p_partkey % 3 = 0 THEN 1 END AS pad, CASE WHEN p_partkey % 5 = 3 THEN 2 + p_size % 2 END AS div_columns, CASE WHEN p_partkey % 5 = 3 THEN 2 END AS div_rows
  FROM part),
s AS (SELECT s_suppkey AS sheet, 2 + s_nationkey % 2 AS s_columns, 2 AS s_rows, CASE WHEN s_nationkey % 4 = 0 THEN 12 END AS s_w, CASE WHEN s_nationkey % 4 = 0 THEN 11 END AS s_h, s_nationkey % 3 AS s_pad FROM supplier),
j AS (SELECT q.*, s.* EXCLUDE sheet, s.sheet IS NOT NULL AS there, columns IS NOT NULL OR rows IS NOT NULL AS counts, cell_w IS NOT NULL OR cell_h IS NOT NULL AS cell
      FROM q LEFT JOIN s ON s.sheet = q.sheet),
f AS (SELECT *, there AND NOT counts AND NOT cell AND div_columns IS NULL AS fill,
             there AND NOT counts AND NOT cell AND div_columns IS NOT NULL AND (div_columns <> s_columns OR div_rows <> s_rows) AS mismatch FROM j),
a AS (SELECT *, coalesce(pad, CASE WHEN fill THEN s_pad END, 0) AS p, CASE WHEN fill THEN s_w ELSE coalesce(cell_w, cell_h) END AS w, CASE WHEN fill THEN s_h ELSE coalesce(cell_h, cell_w) END AS h FROM f),
b AS (SELECT *, coalesce(CASE WHEN fill THEN s_columns ELSE coalesce(columns, div_columns) END, (width + p) // (w + p)) AS c,
             coalesce(CASE WHEN fill THEN s_rows ELSE coalesce(rows, div_rows) END, (height + p) // (h + p)) AS r FROM a),
d AS (SELECT *, coalesce(w, CASE WHEN c > 0 THEN floor((width - p * (c - 1)) / c) END) AS cw, coalesce(h, CASE WHEN r > 0 THEN floor((height - p * (r - 1)) / r) END) AS ch FROM b),
k AS (SELECT *, CASE WHEN mismatch THEN 'packing mismatch' WHEN c IS NULL OR r IS NULL THEN 'no grid'
        WHEN coalesce(least(c, r, cw, ch) <= 0 OR c * cw + (c - 1) * p > width OR r * ch + (r - 1) * p > height, true) THEN 'does not fit' END AS problem FROM d)"""


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    requests = table(spark, sf_dir, "part").select(
        k.alias("sheet"), (size + 40).alias("width"), (k % 40 + 30).alias("height"),
        F.when(k % 5 == 1, k % 4 + 1).alias("columns"), F.when(k % 10 == 1, size % 3 + 1).alias("rows"),
        F.when((k % 5).isin(1, 2), size % 9 + 5).alias("cell_w"), F.when(k % 7 == 2, 6).alias("cell_h"), F.when(k % 3 == 0, 1).alias("pad"),
        F.when(k % 5 == 3, size % 2 + 2).alias("div_columns"), F.when(k % 5 == 3, 2).alias("div_rows"),
    )
    n = F.col("s_nationkey")
    sidecars = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sheet"), (n % 2 + 2).alias("columns"), F.lit(2).alias("rows"), F.when(n % 4 == 0, 12).alias("cell_w"), F.when(n % 4 == 0, 11).alias("cell_h"), (n % 3).alias("pad")
    )
    return sheets.packings(requests, sidecars, "sheet")


@registered("sheet_packings", f"""WITH {REQ}
SELECT sheet, CASE WHEN problem IS NULL THEN c END::BIGINT AS columns, CASE WHEN problem IS NULL THEN r END::BIGINT AS rows, CASE WHEN problem IS NULL THEN cw END::BIGINT AS cell_w,
       CASE WHEN problem IS NULL THEN ch END::BIGINT AS cell_h, CASE WHEN problem IS NULL THEN p END::BIGINT AS pad, problem FROM k""")
def sheet_packings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir)


@registered("sheet_cells", f"""WITH {REQ}, e AS (SELECT *, unnest(range(0, (c * r)::BIGINT)) AS frame_index FROM k WHERE problem IS NULL)
SELECT sheet, frame_index, ((frame_index % c) * (cw + p))::BIGINT AS x, ((frame_index // c) * (ch + p))::BIGINT AS y, cw::BIGINT AS width, ch::BIGINT AS height FROM e""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.cells(packed(spark, sf_dir), ["sheet"])


@registered("pack_slots", f"""WITH {EV}
SELECT user_id, frame_index, concat(frame_index - user_id % 4, '.png') AS copy_name FROM e WHERE frame_index BETWEEN user_id % 4 AND user_id % 4 + 5""")
def pack_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("user_id") % 4
    return sheets.slots(user_frames(spark, sf_dir), ["user_id"], start, start + 5)


@registered("steadiness", f"""WITH {EV}, n AS (SELECT user_id, count(*) AS frames FROM e GROUP BY user_id),
f AS (SELECT user_id, abs(cents) % 1000 AS centre, abs(cents) % 700 + 300 AS area FROM e WHERE cents % 3 <> 0),
s AS (SELECT user_id, count(*) AS n, sum(centre) AS c, sum(area) AS a FROM f GROUP BY user_id HAVING count(*) > 1),
d AS (SELECT user_id, n, a, sum(abs(centre * n - c))::BIGINT AS dc, sum(abs(area * n - a))::BIGINT AS da FROM f JOIN s USING (user_id) GROUP BY ALL)
SELECT user_id, n, cast(floor(least(1, greatest(0, n::DOUBLE / frames - 2 * (dc / (n * n * 1000)::DOUBLE) - da / greatest(1, (n * a)::DOUBLE))) * 1000 + 0.5) AS BIGINT) AS score_milli
FROM d JOIN n USING (user_id)""")
def steadiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = user_frames(spark, sf_dir)
    n = f.groupBy("user_id").agg(F.count("*").alias("frames"))
    found = f.where("cents % 3 <> 0").select("user_id", (F.abs("cents") % 1000).alias("centre"), (F.abs("cents") % 700 + 300).alias("area"))
    out = sheets.steadiness(found, n, ["user_id"], "centre", "area")
    return out.select("user_id", "n", F.floor(F.col("score") * 1000 + 0.5).cast("long").alias("score_milli"))
