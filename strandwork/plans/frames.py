"""Registered queries over frames and their documents: verdicts and records of images, contact sheets, merges with checks,
renames, cells and geometry, texts of settings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import color, medians, text
from strandwork.operators import documents, likeness, manifests, rasters, sequences, sheets, spatial, timeline
from strandwork.plans.catalog import EV, OR, U, order_frames, part_colours, registered, user_frames
from strandwork.plans.rasters import PX, SIDE, I, pixels
from strandwork.session import table


@registered("cut_verdicts", f"""WITH {PX},
m AS (SELECT *, x < 3 OR x >= 5 OR y < 3 OR y >= 5 AS band, x IN (0, 7) OR y IN (0, 7) AS rim, a <= 128 AS clear,
             greatest(r, g, b) - least(r, g, b) <= 24 OR (g > r + 24 AND g > b + 24) AS plate FROM px),
c AS (SELECT image_id, count(*) FILTER (band) AS band, count(*) FILTER (band AND clear) AS clear, count(*) FILTER (band AND NOT clear AND plate) AS plates,
             count(*) FILTER (rim) AS rim, count(*) FILTER (rim AND clear) AS open, count(*) FILTER (NOT band) AS inside, count(*) FILTER (NOT band AND clear) AS holes FROM m GROUP BY image_id)
SELECT image_id, CASE WHEN plates * 2 >= band THEN holes * 2 >= inside WHEN clear * 2 >= band THEN true WHEN plates > 0 AND holes * 2 < inside THEN false ELSE open * 2 >= rim END AS cut, band, clear, plates FROM c""")
def cut_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.cut_out(pixels(spark, sf_dir), I, SIDE, SIDE, manifests.keyable(F.col("r"), F.col("g"), F.col("b")), 128)


@registered("frame_measurements", f"""WITH {PX},
v AS (SELECT *, max(y) OVER (PARTITION BY image_id) AS low FROM px WHERE a > 16)
SELECT image_id, max(x) - min(x) + 1 AS body_width, max(y) - min(y) + 1 AS body_height, max(y) AS feet_y, min(y) + max(y) AS centre_y_x2, count(*) AS opaque,
       count(*) FILTER (a >= 200 AND 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b >= 240) AS near_white,
       floor((sum(x) FILTER (y = low)) * 1000 / (count(*) FILTER (y = low)) + 0.5)::BIGINT AS sole_x_milli FROM v GROUP BY image_id""")
def frame_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.frame_measurements(pixels(spark, sf_dir), I)


@registered("overlay", f"""WITH {PX},
l AS (SELECT image_id // 2 AS pair, x, y FROM px WHERE a > 16 AND image_id % 2 = 0), q AS (SELECT image_id // 2 AS pair, x, y FROM px WHERE a > 16 AND image_id % 2 = 1)
SELECT coalesce(l.pair, q.pair) AS pair, coalesce(l.x, q.x) AS x, coalesce(l.y, q.y) AS y, CASE WHEN l.pair IS NULL THEN 0 ELSE 255 END AS r, CASE WHEN q.pair IS NULL THEN 0 ELSE 255 END AS g, CASE WHEN q.pair IS NULL THEN 0 ELSE 255 END AS b
FROM l FULL JOIN q ON l.pair = q.pair AND l.x = q.x AND l.y = q.y""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("pair", F.floor(F.col("image_id") / 2).cast("long"))
    return rasters.overlay(px.where("image_id % 2 = 0"), px.where("image_id % 2 = 1"), ["pair"])


@registered("corner_colours", f"""WITH {PX},
t AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM px WHERE (x < 3 OR x >= 5) AND (y < 3 OR y >= 5)),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (g - b) / d WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60::DOUBLE AS h1, CASE WHEN hi = 0 THEN 0 ELSE d / hi END AS s FROM t)
SELECT image_id, (y >= 5)::INT * 2 + (x >= 5)::INT AS corner, floor(avg(s) * 1000 + 0.5)::BIGINT AS s_milli, floor(avg(a) * 1000 + 0.5)::BIGINT AS a_milli,
       floor((degrees(atan2(avg(sin(radians(h1))), avg(cos(radians(h1))))) + 360) % 360 * 1000 + 0.5)::BIGINT AS h_milli FROM h GROUP BY ALL""")
def corner_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("frame_index", F.lit(0))
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(f"{c}_milli")
    return likeness.corners(px, I, SIDE, SIDE, 3).select("image_id", "corner", milli("s"), milli("a"), milli("h"))


@registered("contact_sheet", f"""WITH {PX},
n AS (SELECT label, image_id, row_number() OVER (PARTITION BY label ORDER BY image_id) - 1 AS f, least(8, count(*) OVER (PARTITION BY label)) AS wide FROM (SELECT DISTINCT label, image_id FROM px)),
d AS (SELECT *, 2 + f % wide * 14 AS x0, 2 + f // wide * 14 AS y0, i, j FROM n, (SELECT unnest(range(12)) AS i), (SELECT unnest(range(12)) AS j))
SELECT d.label, f AS frame_index, x0 + i AS sheet_x, y0 + j AS sheet_y, coalesce(px.r, t) AS r, coalesce(px.g, t) AS g, coalesce(px.b, t) AS b
FROM (SELECT *, CASE WHEN (i // 4 + j // 4) % 2 = 0 THEN 200 ELSE 150 END AS t FROM d) d
LEFT JOIN px ON px.image_id = d.image_id AND px.a > 16 AND px.x = floor((i + 0.5) * 8 / 12) AND px.y = floor((j + 0.5) * 8 / 12)""")
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's images in cells of twelve pixels, two apart."""
    from pyspark.sql import Window as W

    px = pixels(spark, sf_dir)
    place = px.select("label", *I).distinct().withColumn("frame_index", F.row_number().over(W.partitionBy("label").orderBy(*I)).cast("long") - 1)
    placed = sheets.contact_cells(place, ["label"], 8, 12, 2)
    return sheets.contact_pixels(px.join(place, ["label", *I]), placed, ["label"], SIDE, SIDE, 12).select("label", "frame_index", F.col("sheet_x").cast("long").alias("sheet_x"), F.col("sheet_y").cast("long").alias("sheet_y"), "r", "g", "b")


@registered("metric_summary", f"""WITH {EV} SELECT event_type, count(*) AS n, min(cents) AS least, max(cents) AS most, median(cents) AS middle, sum(cents)::BIGINT AS total FROM e GROUP BY event_type""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians.summary(user_frames(spark, sf_dir), ["event_type"], "cents")


@registered("spread_samples", """WITH n AS (SELECT user_id, user_id % 5 AS low, user_id % 5 + count(*) - 1 AS high, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 120 END AS k FROM events GROUP BY user_id),
i AS (SELECT *, unnest(range(k)) AS i FROM n)
SELECT user_id, i AS sample, CASE WHEN k = 1 THEN floor((low + high) / 2 + 0.5) ELSE floor(low + i * (high - low)::DOUBLE / (k - 1) + 0.5) END::BIGINT AS frame_index FROM i""")
def spread_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One, seven or 120 places of each user's events, from an offset on."""
    low = F.col("user_id") % 5
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    count = F.when(F.col("user_id") % 3 == 0, 1).when(F.col("user_id") % 3 == 1, 7).otherwise(120)
    return n.select("user_id", F.posexplode(sequences.spread_places(low, low + F.col("n") - 1, count)).alias("sample", "frame_index")).withColumn("sample", F.col("sample").cast("long"))


@registered("played_frames", f"""WITH {EV}, s AS (SELECT *, event_id % 4 = 0 AS off FROM e)
SELECT user_id, count(*) FILTER (NOT off) AS kept, count(*) FILTER (off) AS skipped, coalesce(string_agg(frame_index::VARCHAR, ',' ORDER BY frame_index) FILTER (NOT off), '') AS frames FROM s GROUP BY user_id""")
def played_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = user_frames(spark, sf_dir)
    overrides = seq.where("event_id % 4 IN (0, 1)").select("user_id", "frame_index", (F.col("event_id") % 4 == 0).alias("disabled"))
    kept, counts = timeline.played(seq, overrides, ["user_id", "frame_index"], U)
    order = kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_index", "frame_index"))), lambda x: x["frame_index"].cast("string")), ",").alias("frames"))
    return counts.join(order, U, "left").fillna("", ["frames"])


@registered("merge_problems", """WITH m AS (SELECT c_nationkey * 3 + c_custkey % 3 AS merged, c_mktsegment AS anchor, c_custkey % 400 = 7 AS flip FROM customer WHERE c_nationkey % 2 = 0 OR c_mktsegment = 'BUILDING')
SELECT merged, CASE WHEN count(*) > 40 THEN 'too many members' WHEN count(DISTINCT anchor) > 1 THEN 'different anchor' WHEN count(DISTINCT flip) > 1 THEN 'different flip' END AS problem FROM m GROUP BY merged""")
def merge_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0 OR c_mktsegment = 'BUILDING'")
    members = c.select((F.col("c_nationkey") * 3 + k % 3).alias("merged"), k.alias("position"), F.col("c_mktsegment").alias("anchor"), (k % 400 == 7).alias("flip"))
    return documents.merge_problems(members, ["anchor", "flip"], 40)


@registered("renamed_bindings", f"""WITH {OR},
b AS (SELECT o_orderkey, 'hero/' || o_custkey AS owner, 'hero/' || o_custkey || CASE WHEN o_orderkey % 3 > 0 THEN ':' || frame_index ELSE '' END AS key, 'hero/' || (o_custkey + o_orderkey % 2) || ':' || frame_index AS other FROM o)
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN owner ELSE 'npc/' || c_custkey END AS owner, CASE WHEN c_custkey IS NULL THEN key ELSE 'npc/' || c_custkey || substr(key, length(owner) + 1) END AS key,
       CASE WHEN c_custkey IS NULL OR NOT starts_with(other, owner || ':') THEN other ELSE 'npc/' || c_custkey || substr(other, length(owner) + 1) END AS other
FROM b LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 3000) ON 'hero/' || c_custkey = owner""")
def renamed_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = order_frames(spark, sf_dir), F.col("o_custkey")
    owner, frame = F.concat(F.lit("hero/"), k), F.concat(F.lit(":"), "frame_index")
    b = o.select("o_orderkey", owner.alias("owner"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(owner, frame)).otherwise(owner).alias("key"), F.concat(F.lit("hero/"), k + F.col("o_orderkey") % 2, frame).alias("other"))
    names = table(spark, sf_dir, "customer").where("c_acctbal < 3000").select(F.concat(F.lit("hero/"), "c_custkey").alias("old"), F.concat(F.lit("npc/"), "c_custkey").alias("new"))
    return documents.renamed(b, names, "owner", ["key", "other"])


@registered("merged_keys", f"""WITH {OR}, n AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey),
m AS (SELECT c_custkey, c_nationkey, coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM n JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, 'n/' || c_nationkey || ':' || (frame_index + shift) AS key, CASE WHEN o_orderkey % 2 = 0 THEN -cents ELSE cents END AS x, CASE WHEN o_orderkey % 2 = 0 THEN -15 ELSE 15 END AS rotation FROM o JOIN m ON c_custkey = o_custkey""")
def merged_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers merged: keys of their frames under the new owner, boxes of turned frames mirrored."""
    o = order_frames(spark, sf_dir)
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("merged"), F.col("c_custkey").alias("position"))
    chained = documents.merge_sequences(o.withColumn("at", F.col("frame_index")), members, "o_custkey")
    old, new = F.concat(F.lit("c/"), "o_custkey"), F.concat(F.lit("n/"), "merged")
    key = documents.rewritten_key(F.concat(old, F.lit(":"), "at"), old, new, F.col("frame_index") - F.col("at"))
    box = documents.mirrored(F.col("cents"), F.lit(15), F.col("o_orderkey") % 2 == 0)
    return chained.select("o_orderkey", key.alias("key"), box["x"].alias("x"), box["rotation"].alias("rotation"))


@registered("used_assets", """SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def used_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return documents.still_used(table(spark, sf_dir, "part").select("p_partkey", "p_name"), bindings, ["p_partkey"])


@registered("grid_ticks", """WITH v AS (SELECT p_partkey, -(p_partkey % 90) * 1.0::DOUBLE AS low, p_size * 4.0::DOUBLE AS high, [1, 2, 5, 10, 20][p_partkey % 5 + 1]::DOUBLE * 2.5::DOUBLE AS step FROM part)
SELECT p_partkey, k * step AS tick FROM (SELECT *, unnest(range(ceil(low / step)::BIGINT, floor(high / step)::BIGINT + 1)) AS k FROM v)""")
def grid_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select("p_partkey", (-(k % 90)).cast("double").alias("low"), (F.col("p_size") * 4.0).alias("high"))
    step = F.element_at(F.array(*map(F.lit, (1, 2, 5, 10, 20))), (k % 5 + 1).cast("int")) * 2.5
    return spatial.grid_ticks(v, "low", "high", step).select("p_partkey", "tick")


@registered("cell_geometry", """WITH v AS (SELECT p_partkey, p_partkey % 50 AS x, p_size AS y, 100 + p_partkey % 33 AS w, 90 + p_size AS h, unnest([0, 1, 2]) AS i FROM part),
n AS (SELECT *, (p_partkey + i * 2) % 6 AS c, (p_size_row + i) % 5 + 1 AS r FROM (SELECT *, y AS p_size_row FROM v)),
b AS (SELECT p_partkey, x + c * w / 5 AS x1, x + (c + 1) * w / 5 AS x2, y + (r - 1) * h / 4 AS y1, y + r * h / 4 AS y2 FROM n WHERE c < 5 AND r <= 4),
u AS (SELECT p_partkey, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, median((x1 + x2) / 2) AS mid_x, median((y1 + y2) / 2) AS mid_y FROM b GROUP BY p_partkey)
SELECT p_partkey, floor(mid_x * 1000 + 0.5)::BIGINT AS mid_x_milli, floor(mid_y * 1000 + 0.5)::BIGINT AS mid_y_milli, floor(x1)::BIGINT AS crop_x, floor(y1)::BIGINT AS crop_y, (ceil(x2) - floor(x1))::BIGINT AS crop_width, (ceil(y2) - floor(y1))::BIGINT AS crop_height,
       floor(CASE p_partkey % 5 WHEN 3 THEN x1 WHEN 4 THEN x2 ELSE (x1 + x2) / 2 END * 1000 + 0.5)::BIGINT AS point_x_milli, floor(CASE p_partkey % 5 WHEN 1 THEN y2 WHEN 2 THEN y1 ELSE (y1 + y2) / 2 END * 1000 + 0.5)::BIGINT AS point_y_milli,
       floor(least(-y1, -y2) * 2 + 7.5)::BIGINT AS turned_x1, floor(greatest(x1, x2) * 3 + 0.5)::BIGINT AS turned_y2 FROM u""")
def cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three named cells of a view of five by four: their union, its crop and point, their median, and bounds once turned."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = lambda i: F.concat(F.char(65 + (k + i * 2) % 6), ((size + i) % 5 + 1).cast("string"))
    views = table(spark, sf_dir, "part").select("p_partkey", (k % 50).alias("x"), size.alias("y"), (k % 33 + 100).alias("width"), (size + 90).alias("height"), F.lit(5).alias("columns"), F.lit(4).alias("rows"), F.array(*map(name, range(3))).alias("cells"))
    union = spatial.cell_union(spatial.named_cells(views, "cells"), ["p_partkey"])
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    mode = F.element_at(F.array(*map(F.lit, ("center", "bottom_center", "top_center", "left_center", "right_center"))), (k % 5 + 1).cast("int"))
    crop, point = spatial.integer_crop(box), spatial.derived_point(box, mode)
    turned = spatial.transformed_bounds(box, (F.lit(3.0), F.lit(2.0)), F.lit(90.0), (F.lit(7.0), F.lit(0.0)))
    milli = lambda v, n: F.floor(v * 1000 + 0.5).cast("long").alias(n)
    whole = lambda v, n: F.floor(v + 0.5).cast("long").alias(n)
    return union.select(
        "p_partkey", milli(F.col("mid_x"), "mid_x_milli"), milli(F.col("mid_y"), "mid_y_milli"), *[crop[c].alias(f"crop_{c}") for c in ("x", "y", "width", "height")],
        milli(point["x"], "point_x_milli"), milli(point["y"], "point_y_milli"), whole(F.round(turned["x1"], 6), "turned_x1"), whole(F.round(turned["y2"], 6), "turned_y2"),
    )


@registered("oklab_round_trip", "SELECT p_partkey, p_partkey % 256 AS r, p_size * 5 AS g, cast(floor(p_retailprice) AS BIGINT) % 256 AS b FROM part")
def oklab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = part_colours(spark, sf_dir).withColumn("lab", color.oklab(F.col("r"), F.col("g"), F.col("b")))
    return c.withColumn("back", color.from_oklab(F.col("lab.l"), F.col("lab.a"), F.col("lab.b"))).select("p_partkey", "back.r", "back.g", "back.b")


@registered("parsed_settings", """WITH t AS (SELECT p_partkey AS k, ['1', ' TRUE', 'yes', '0', 'No ', 'maybe', ''][p_partkey % 7 + 1] AS flag FROM part)
SELECT k AS p_partkey, CASE WHEN k % 7 <= 2 THEN true WHEN k % 7 <= 4 THEN false ELSE k % 2 = 0 END AS flag,
       CASE WHEN k % 6 IN (0, 1, 2, 3) THEN k::DOUBLE END AS x, CASE k % 6 WHEN 0 THEN -2.5 WHEN 1 THEN 3 WHEN 2 THEN -4 WHEN 3 THEN 5 END::DOUBLE AS y,
       CASE WHEN k % 3 = 0 AND k % 70 BETWEEN 2 AND 64 THEN k % 70 WHEN k % 3 = 1 AND k % 50 BETWEEN 2 AND 64 THEN k % 50 END::INT AS div_x,
       CASE WHEN k % 3 = 0 AND k % 70 BETWEEN 2 AND 64 THEN 8 WHEN k % 3 = 1 AND k % 50 BETWEEN 2 AND 64 THEN k % 50 END::INT AS div_y,
       '{"a":[1,{"b":null,"c":"x"}],"k":' || k || ',"z":{"a":true,"b":2.5}}' AS sorted FROM t""")
def parsed_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, points in their forms, divisions and nested objects, written and read again."""
    k = F.col("p_partkey")
    s = k.cast("string")
    flag = F.element_at(F.array(*map(F.lit, ("1", " TRUE", "yes", "0", "No ", "maybe", ""))), (k % 7 + 1).cast("int"))
    forms = [F.concat(s, F.lit(" , -2.5")), F.concat(F.lit("["), s, F.lit(", 3]")), F.concat(F.lit('{"group": {"x": '), s, F.lit(', "y": -4}}')), F.concat(F.lit('{"y": 5, "x": '), s, F.lit("}")), F.concat(F.lit('{"space": "canvas", "x": 1, "y": '), s, F.lit("}"))]
    point = F.lit("1;2")
    for i, form in enumerate(forms):
        point = F.when(k % 6 == i, form).otherwise(point)
    division = F.when(k % 3 == 0, F.concat((k % 70).cast("string"), F.lit(" x 8"))).when(k % 3 == 1, (k % 50).cast("string")).otherwise("8 by 8")
    nested = F.concat(F.lit('{"z": {"b": 2.5, "a": true}, "k": '), s, F.lit(', "a": [1, {"c": "x", "b": null}]}'))
    p = table(spark, sf_dir, "part").select("p_partkey", text.parse_flag(flag, k % 2 == 0).alias("flag"), text.parse_point(point).alias("p"), text.parse_divisions(division).alias("d"), documents.canonical_json(nested).alias("sorted"))
    return p.select("p_partkey", "flag", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("d.x").alias("div_x"), F.col("d.y").alias("div_y"), "sorted")


@registered("revision_listing", """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS place FROM orders""")
def revision_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as revisions, newest first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    listed = sequences.ordered(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return listed.select("o_custkey", "o_orderkey", text.iso_stamp(F.col("o_orderdate")).alias("created_at"), F.col("frame_index").cast("long").alias("place"))
