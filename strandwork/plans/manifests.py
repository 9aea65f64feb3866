"""Registered queries over manifests, revisions and placements, each with its SQL: a customer's orders are a manifest, with
order states as profiles and priorities as animations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import manifests
from strandwork.plans.catalog import EV, OR, RGB, C, order_frames, part_colours, registered, user_frames
from strandwork.session import table


def scaled(column, factor: float):
    """A whole number of parts, halves up."""
    return F.floor(column * factor + 0.5).cast("long")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = order_frames(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), F.col("o_orderkey") % 400))
    frames = F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "path", "cents"))), lambda x: F.struct(x["path"].alias("path"), x["cents"].alias("cents")))
    a = o.groupBy(*C, "o_orderstatus", "o_orderpriority").agg(frames.alias("frames"))
    named = F.struct(
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("id"),
        F.when(F.col("o_custkey") % 3 < 2, F.concat(F.lit("n"), "o_orderpriority")).alias("name"),
        F.when(F.col("o_custkey") % 2 == 0, "effect").alias("type"),
        F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 4 * 6).cast("double")).alias("fps"),
        "frames",
    )
    p = a.groupBy(*C, "o_orderstatus").agg(F.collect_list(named).alias("animations"))
    return p.groupBy(*C).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").alias("kind"), "animations")).alias("profiles"))


MF = f"""{OR},
m AS (SELECT *, o_orderstatus AS profile_id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'actor' END AS kind,
        CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority ELSE 'n' || o_orderpriority END AS animation_id,
        CASE WHEN o_custkey % 3 < 2 THEN 'n' || o_orderpriority ELSE o_orderpriority END AS name,
        CASE WHEN o_custkey % 2 = 0 THEN 'effect' ELSE 'actor' END AS type, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 4 * 6)::DOUBLE ELSE 12.0::DOUBLE END AS fps,
        'f' || (o_orderkey % 400) AS path FROM o)"""


@registered("manifest_animations", f"""WITH {MF}
SELECT o_custkey, profile_id, kind, animation_id, name, type, fps, count(*) AS frame_count FROM m GROUP BY ALL""")
def manifest_animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.animations_of(nested(spark, sf_dir), C).drop("frames")


@registered("manifest_frames", f"""WITH {MF}
SELECT o_custkey, profile_id, animation_id, cents, m.path,
       row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY frame_index) - 1 AS frame_index,
       p.path IS NOT NULL AS "exists"
FROM m LEFT JOIN (SELECT DISTINCT 'f' || (p_partkey % 400) AS path FROM part WHERE p_size > 40) p ON p.path = m.path""")
def manifest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = manifests.frames_of(manifests.animations_of(nested(spark, sf_dir), C))
    files = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("f"), F.col("p_partkey") % 400).alias("path"))
    return manifests.existing(frames, files, "path").select("o_custkey", "profile_id", "animation_id", "cents", "path", "frame_index", "exists")


@registered("generated_frames", f"""WITH {MF},
p AS (SELECT DISTINCT 'f' || (p_partkey % 400) AS path FROM part WHERE p_size > 40)
SELECT o_custkey, profile_id, animation_id, count(*) AS frame_count, count(p.path) AS generated_count, count(*) = count(p.path) AS all_generated
FROM m LEFT JOIN p ON p.path = m.path GROUP BY ALL""")
def generated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.generated(manifest_frames(spark, sf_dir), ["o_custkey", "profile_id", "animation_id"])


@registered("clip_sections", """WITH e AS (
  SELECT p_partkey, ['boxes', 'timing', 'visual', 'sfx', 'attachments', 'trails'][p_partkey % 6 + 1] AS section, (p_partkey % 9) / 4 AS duration,
         CASE p_partkey % 7 WHEN 0 THEN 'global' ELSE p_brand || '/' || p_type || ':' || p_size END AS key FROM part)
SELECT p_partkey, section, regexp_extract(key, '^(.+):(\\d+)$', 1) AS binding, regexp_extract(key, '^(.+):(\\d+)$', 2)::BIGINT AS frame,
       CASE WHEN section = 'timing' THEN cast(floor(CASE WHEN duration <> 0 THEN duration ELSE 1 END * 1000 / 12 + 0.5) AS BIGINT) END AS duration_ms
FROM e WHERE section IN ('timing', 'sfx', 'trails') AND regexp_matches(key, '^.+:\\d+$')""")
def clip_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    key = F.when(k % 7 == 0, "global").otherwise(F.concat("p_brand", F.lit("/"), "p_type", F.lit(":"), F.col("p_size").cast("string")))
    section = F.element_at(F.array(*map(F.lit, manifests.SECTIONS)), (k % 6 + 1).cast("int"))
    e = table(spark, sf_dir, "part").select("p_partkey", section.alias("section"), key.alias("key"), (k % 9 / 4).alias("duration"))
    out = manifests.sections(e, ["timing", "sfx", "trails"])
    return out.select("p_partkey", "section", "binding", "frame", F.when(F.col("section") == "timing", manifests.duration_ms(F.col("duration"), F.lit(12))).alias("duration_ms"))


@registered("drawn_segments", """WITH s AS (
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled, CASE p_partkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS made,
         CASE p_partkey % 3 WHEN 0 THEN 'sweep' WHEN 1 THEN 'mesh' END AS mode, CASE p_partkey % 4 WHEN 0 THEN 'polyline' WHEN 1 THEN 'smooth_arc' END AS path_kind, p_size % 4 AS sticks FROM part)
SELECT p_partkey, coalesce(enabled, true) AND coalesce(made, true) AND coalesce(mode, '') <> 'sweep' AND coalesce(path_kind, '') <> 'polyline' AND sticks >= 2 AS mesh,
       coalesce(enabled, true) AND coalesce(mode, '') = 'sweep' AND sticks >= 2 AS sweep FROM s""")
def drawn_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    flag = lambda m, none, off: F.when(k % m == none, F.lit(None).cast("boolean")).otherwise(k % m != off)
    told = (flag(5, 0, 1), flag(7, 1, 0), F.when(k % 3 == 0, "sweep").when(k % 3 == 1, "mesh"), F.when(k % 4 == 0, "polyline").when(k % 4 == 1, "smooth_arc"), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", manifests.usable_segment(*told).alias("mesh"), manifests.usable_segment(*told, sweep=True).alias("sweep"))


@registered("plates", f"""WITH {RGB.replace('cast(p_retailprice AS BIGINT)', 'cast(floor(p_retailprice) AS BIGINT)')}
SELECT p_partkey, greatest(r, g, b) - least(r, g, b) <= 24 AS plate, greatest(r, g, b) - least(r, g, b) <= 24 OR (g > r + 24 AND g > b + 24) AS keyable FROM c""")
def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.col("r"), F.col("g"), F.col("b")
    return part_colours(spark, sf_dir).select("p_partkey", manifests.plate(*rgb).alias("plate"), manifests.keyable(*rgb).alias("keyable"))


@registered("resolved_owner", """WITH q AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS named, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 40 END AS around FROM part)
SELECT p_partkey, CASE WHEN named IS NOT NULL THEN n.n_nationkey WHEN a.n_nationkey IS NOT NULL THEN a.n_nationkey ELSE (SELECT arg_min(n_nationkey, n_name) FROM nation) END AS n_nationkey
FROM q LEFT JOIN nation n ON n.n_nationkey = named LEFT JOIN nation a ON a.n_nationkey = around""")
def resolved_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    q = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.col("p_size")).cast("int").alias("named"), F.when(k % 2 == 0, k % 40).cast("int").alias("around"))
    return manifests.resolve(q, table(spark, sf_dir, "nation"), "n_nationkey", "named", "around", ["n_name"]).select("p_partkey", "n_nationkey")


@registered("reference_deltas", f"""WITH {EV},
r AS (SELECT user_id, event_type, cents, length(props) AS size FROM e WHERE frame_index = 2)
SELECT e.user_id, e.frame_index, e.cents - r.cents AS cents_delta, (length(e.props) - r.size)::BIGINT AS size_delta FROM e LEFT JOIN r ON r.user_id = e.user_id""")
def reference_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's frames against their third."""
    seq = user_frames(spark, sf_dir).select("user_id", "frame_index", "cents", F.length("props").cast("long").alias("size"))
    return manifests.against(seq, seq.where("frame_index = 2"), ["user_id"], ["cents", "size"]).drop("cents", "size")


@registered("shifted_points", f"""WITH {EV},
s AS (SELECT user_id, frame_index, event_id % 11 - 5 AS dx, event_id % 7 - 3 AS dy FROM e WHERE event_id % 4 = 0)
SELECT e.user_id, e.frame_index, e.cents + coalesce(dx, 0) AS x, e.event_id % 100 + coalesce(dy, 0) AS y FROM e LEFT JOIN s ON s.user_id = e.user_id AND s.frame_index = e.frame_index""")
def shifted_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, keys = user_frames(spark, sf_dir), ["user_id", "frame_index"]
    shifts = e.where("event_id % 4 = 0").select(*keys, (F.col("event_id") % 11 - 5).alias("dx"), (F.col("event_id") % 7 - 3).alias("dy"))
    return manifests.shift_points(e.select(*keys, F.col("cents").alias("x"), (F.col("event_id") % 100).alias("y")), shifts, keys, ["x"], ["y"])


SV = """f AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 AS hash, cast(floor(o_totalprice) AS BIGINT) AS size, o_orderkey % 5 = 0 AS external FROM orders WHERE o_orderkey % 9 > 0 OR o_custkey % 4 = 0),
v AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 6 = 0 AND o_custkey % 4 > 0 THEN -1 ELSE o_orderkey % 7 END AS hash FROM orders WHERE o_orderkey % 8 > 0 OR o_custkey % 4 = 0)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    whole = F.col("o_custkey") % 4 == 0
    now = o.where((k % 9 > 0) | whole).select("o_custkey", "o_orderkey", (k % 7).alias("hash"), F.floor("o_totalprice").cast("long").alias("size"), (k % 5 == 0).alias("external"))
    then = o.where((k % 8 > 0) | whole).select("o_custkey", "o_orderkey", F.when((k % 6 == 0) & ~whole, -1).otherwise(k % 7).alias("hash"))
    return now, then


@registered("revision_list", f"""WITH {SV}, h AS (SELECT o_custkey, hash, count(*) AS n, sum(size) AS size, max(size) AS one FROM f GROUP BY ALL)
SELECT o_custkey, sum(n)::BIGINT AS file_count, sum(size)::BIGINT AS bytes, sum(one)::BIGINT AS stored_bytes FROM h GROUP BY o_custkey""")
def revision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.revision_list(_files(spark, sf_dir)[0], C)


@registered("restore_plan", f"""WITH {SV}
SELECT coalesce(f.o_custkey, v.o_custkey) AS o_custkey, coalesce(f.o_orderkey, v.o_orderkey) AS o_orderkey,
       CASE WHEN v.hash IS NULL THEN 'remove' WHEN f.hash = v.hash THEN 'same' ELSE 'write' END AS action
FROM f FULL JOIN v ON v.o_custkey = f.o_custkey AND v.o_orderkey = f.o_orderkey WHERE NOT (v.hash IS NULL AND f.external)""")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.restore_plan(*_files(spark, sf_dir), ["o_custkey", "o_orderkey"])


@registered("unchanged_revisions", f"""WITH {SV}
SELECT coalesce(f.o_custkey, v.o_custkey) AS o_custkey, bool_and(coalesce(f.hash = v.hash, false)) AS unchanged
FROM f FULL JOIN v ON v.o_custkey = f.o_custkey AND v.o_orderkey = f.o_orderkey GROUP BY ALL""")
def unchanged_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.unchanged(*_files(spark, sf_dir), C, ["o_orderkey"])


@registered("attachment_placement", """WITH p AS (
  SELECT p_partkey, (p_partkey % 41 - 20)::DOUBLE AS ox, (p_partkey % 29 - 14)::DOUBLE AS oy, p_size / 20 AS sx, p_size % 9 / 4 AS sy, (p_partkey % 90)::DOUBLE AS turn,
         1 + p_partkey % 3 / 2 AS own, (p_partkey % 73 * 5)::DOUBLE AS own_turn, p_partkey % 2 = 0 AS flip FROM part),
q AS (SELECT *, CASE WHEN flip THEN -1.0 ELSE 1.0 END AS facing FROM p),
r AS (SELECT *, ox * own * 2.0 * facing AS x, oy * own * 2.0 AS y, own_turn * facing * pi() / 180 AS a FROM q)
SELECT p_partkey, cast(floor((x * cos(a) - y * sin(a)) * 1e5::DOUBLE + 0.5) AS BIGINT) AS x_parts, cast(floor((x * sin(a) + y * cos(a)) * 1e5::DOUBLE + 0.5) AS BIGINT) AS y_parts,
       cast(floor(greatest(0.001::DOUBLE, own * greatest(0.001::DOUBLE, sx) * 2.0) * 1e5::DOUBLE + 0.5) AS BIGINT) AS scale_x_parts, cast(floor(greatest(0.001::DOUBLE, own * greatest(0.001::DOUBLE, sy) * 2.0) * 1e5::DOUBLE + 0.5) AS BIGINT) AS scale_y_parts,
       ((own_turn + turn) * facing)::DOUBLE AS rotation, CASE WHEN abs(p_partkey % 5 - 2) > 0.0001 THEN (p_partkey % 5 - 2)::DOUBLE WHEN p_partkey % 2 = 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS layer_order FROM r""")
def attachment_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    own = 1 + k % 3 / 2
    at = manifests.placement([(k % 41 - 20).cast("double"), (k % 29 - 14).cast("double")], [size / 20, size % 9 / 4], (k % 90).cast("double"), [own, own], (k % 73 * 5).cast("double"), k % 2 == 0, 2.0)
    order = manifests.layer_order((k % 5 - 2).cast("double"), F.when(k % 2 == 0, "below").otherwise("above"))
    p = table(spark, sf_dir, "part").select("p_partkey", at.alias("p"), order.alias("layer_order"))
    return p.select("p_partkey", *[scaled(F.col(f"p.{c}"), 1e5).alias(f"{c}_parts") for c in ("x", "y", "scale_x", "scale_y")], "p.rotation", "layer_order")


@registered("placement_proposal", """WITH p AS (
  SELECT p_partkey, 64.0::DOUBLE AS w, 96.0::DOUBLE AS h, (p_size + 4)::DOUBLE AS bw, (p_partkey % 60 + 5)::DOUBLE AS bh, (p_partkey % 64)::DOUBLE AS cx, (p_partkey % 96)::DOUBLE AS cy,
         CASE WHEN p_partkey % 2 = 0 THEN 64.0::DOUBLE ELSE 48.0::DOUBLE END AS w2, 96.0::DOUBLE AS h2, (p_partkey % 37 + 3)::DOUBLE AS bw2, (p_partkey % 48)::DOUBLE AS cx2, (p_partkey % 91)::DOUBLE AS cy2,
         CASE p_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'auto' END AS way FROM part),
q AS (SELECT *, cx - w / 2 AS lean, least(greatest(bw * 1.15::DOUBLE / bw2, 0.25::DOUBLE), 1.25::DOUBLE) AS scale FROM p),
r AS (SELECT *, CASE WHEN way = 'left' THEN -1 WHEN way = 'right' OR lean >= 0 THEN 1 ELSE -1 END AS sign,
             CASE WHEN way <> 'auto' THEN 0.95::DOUBLE ELSE least(greatest(abs(lean) / greatest(1.0::DOUBLE, bw * 0.2::DOUBLE), 0.2::DOUBLE), 0.75::DOUBLE) END AS sure FROM q)
SELECT p_partkey, floor(scale * 1000 + 0.5) / 1000 AS scale, cast(floor(cx + sign * bw * 0.45::DOUBLE - (w2 / 2 + (cx2 - w2 / 2) * scale) + 0.5) AS BIGINT) AS x,
       cast(floor(cy + bh * 0.08::DOUBLE - (h2 / 2 + (cy2 - h2 / 2) * scale) + 0.5) AS BIGINT) AS y, CASE WHEN sign > 0 THEN 'right' ELSE 'left' END AS direction,
       floor(least(greatest(CASE WHEN w = w2 AND h = h2 THEN 0.72::DOUBLE ELSE 0.58::DOUBLE END + sure * 0.2::DOUBLE, 0.6::DOUBLE), 0.91::DOUBLE) * 1000 + 0.5) / 1000 AS confidence FROM r""")
def placement_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    owner = {"width": F.lit(64.0), "height": F.lit(96.0), "box_width": d(F.col("p_size") + 4), "box_height": d(k % 60 + 5), "centre_x": d(k % 64), "centre_y": d(k % 96)}
    other = {"width": F.when(k % 2 == 0, 64.0).otherwise(48.0), "height": F.lit(96.0), "box_width": d(k % 37 + 3), "centre_x": d(k % 48), "centre_y": d(k % 91)}
    way = F.when(k % 3 == 0, "left").when(k % 3 == 1, "right").otherwise("auto")
    return table(spark, sf_dir, "part").select("p_partkey", manifests.proposal(owner, other, way).alias("p")).select("p_partkey", "p.*")


@registered("trail_maths", """WITH p AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 30 - 5) / 10 END AS direct, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 900)::DOUBLE END AS speed, p_partkey % 8 AS schema, (p_partkey % 200 - 20)::DOUBLE AS head,
         p_partkey % 4 = 0 AS reverse, p_size AS tx, p_partkey % 50 AS ty, p_partkey % 31 AS bx, p_partkey % 17 AS by_ FROM part),
o AS (SELECT *, least(greatest(direct, 0), 1) AS own FROM p),
c AS (SELECT *, CASE WHEN direct IS NOT NULL THEN CASE WHEN schema < 6 AND abs(own - 0.7::DOUBLE) < 0.000001::DOUBLE THEN 0.12::DOUBLE ELSE own END
              WHEN speed IS NOT NULL THEN least(greatest(speed / 110 * 0.12::DOUBLE, 0), 1) ELSE 0.12::DOUBLE END AS pace,
             CASE WHEN direct IS NOT NULL THEN least(greatest(direct, 0.1::DOUBLE), 20) WHEN speed IS NOT NULL THEN least(greatest(speed / 680 * 2, 0.1::DOUBLE), 20) ELSE 2 END AS after FROM o)
SELECT p_partkey, cast(floor(pace * 1e6::DOUBLE + 0.5) AS BIGINT) AS before_micro, cast(floor(after * 1e6::DOUBLE + 0.5) AS BIGINT) AS after_micro,
       cast(floor(CASE WHEN pace <= 0 OR head <= 0 THEN 0 WHEN head <= 36 THEN pace * head ELSE least(pace * head, head - 36) END * 1e5::DOUBLE + 0.5) AS BIGINT) AS tail_parts,
       CASE WHEN reverse THEN bx ELSE tx END::BIGINT AS top_x, CASE WHEN reverse THEN ty ELSE by_ END::BIGINT AS bottom_y, (tx + bx) / 2 AS centre_x FROM c""")
def trail_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    direct, speed = F.when(k % 3 > 0, (k % 30 - 5) / 10), F.when(k % 2 == 0, (k % 900).cast("double"))
    before = manifests.chase(direct, speed, True, k % 8)
    point = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    pose = manifests.stick_pose(point(F.col("p_size"), k % 50), point(k % 31, k % 17), k % 4 == 0)
    p = table(spark, sf_dir, "part").select("p_partkey", before.alias("b"), manifests.chase(direct, speed, False).alias("a"), pose.alias("s"), (k % 200 - 20).cast("double").alias("head"))
    return p.select(
        "p_partkey",
        scaled(F.col("b"), 1e6).alias("before_micro"),
        scaled(F.col("a"), 1e6).alias("after_micro"),
        scaled(manifests.tail_start(F.col("head"), F.col("b")), 1e5).alias("tail_parts"),
        F.col("s.top.x").alias("top_x"),
        F.col("s.bottom.y").alias("bottom_y"),
        F.col("s.centre.x").alias("centre_x"),
    )


@registered("stable_background", f"""WITH {OR},
c AS (SELECT o_custkey, frame_index, (o_custkey % 360 + o_orderkey % (CASE WHEN o_custkey % 3 = 0 THEN 9 ELSE 90 END) + k) % 360 AS h,
             CASE WHEN (o_custkey + o_orderkey + k) % 10 < o_custkey % 11 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS s FROM o, (SELECT unnest(range(4)) AS k)),
n AS (SELECT o_custkey, max(frame_index) + 1 AS n FROM o GROUP BY o_custkey),
w AS (SELECT DISTINCT o_custkey, unnest(CASE WHEN n <= 5 THEN range(n) ELSE [0, floor(n * 0.25)::BIGINT, floor(n * 0.5)::BIGINT, floor(n * 0.75)::BIGINT, n - 1] END) AS frame_index FROM n WHERE n > 1),
x AS (SELECT c.* FROM c JOIN w ON w.o_custkey = c.o_custkey AND w.frame_index = c.frame_index),
d AS (SELECT o_custkey, count(*) FILTER (s >= 0.15) / count(*) AS share, avg(sin(radians(h))) FILTER (s >= 0.15) AS y, avg(cos(radians(h))) FILTER (s >= 0.15) AS x FROM x GROUP BY o_custkey),
v AS (SELECT *, CASE WHEN x IS NOT NULL THEN degrees(sqrt(greatest(0, -2 * ln(least(1, sqrt(x * x + y * y)))))) < 15 END AS one FROM d)
SELECT n.o_custkey, coalesce(CASE WHEN share >= 0.6::DOUBLE THEN one ELSE 1 - share >= 0.6::DOUBLE END, false) AS stable FROM n LEFT JOIN v ON v.o_custkey = n.o_custkey""")
def stable_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, o = F.col("k"), F.col("o_custkey"), F.col("o_orderkey")
    corner = order_frames(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    h = (c % 360 + F.when(c % 3 == 0, o % 9).otherwise(o % 90) + k) % 360
    return manifests.stable_background(corner.select("o_custkey", "frame_index", h.alias("h"), F.when((c + o + k) % 10 < c % 11, 0.5).otherwise(0.1).alias("s")), C)


@registered("first_seen_values", f"""WITH {EV},
x AS (SELECT user_id, frame_index, unnest([event_type, 'k' || (event_id % 9), event_type]) AS value, unnest([0, 1, 2]) AS i FROM e),
f AS (SELECT user_id, value, min(frame_index * 3 + i) AS f FROM x GROUP BY ALL)
SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY f) - 1 AS place FROM f""")
def first_seen_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_frames(spark, sf_dir)
    brought = F.array("event_type", F.concat(F.lit("k"), F.col("event_id") % 9), "event_type")
    return manifests.first_seen(e.select("user_id", "frame_index", brought.alias("values")), ["user_id"], "values", ["frame_index"])


@registered("sound_and_keys", """WITH t AS (
  SELECT p_partkey, p_name || ['.wav', '.OGG', '.mp3', '.flac', ''][p_partkey % 5 + 1] AS path FROM part)
SELECT p_partkey, path, CASE lower(regexp_extract(path, '\\.([^./\\\\]+)$', 1)) WHEN 'wav' THEN 'audio/wav' WHEN 'ogg' THEN 'audio/ogg' WHEN 'mp3' THEN 'audio/mpeg' END AS media_type,
       '{"a":"' || p_partkey % 7 || '","b":"x","c":"' || p_partkey % 3 || '"}' AS sorted FROM t""")
def sound_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat("p_name", F.element_at(F.array(*map(F.lit, [".wav", ".OGG", ".mp3", ".flac", ""])), (k % 5 + 1).cast("int")))
    document = F.concat(F.lit('{"c": "'), k % 3, F.lit('", "a": "'), k % 7, F.lit('", "b": "x"}'))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), manifests.audio_type(path).alias("media_type"), manifests.canonical(document).alias("sorted"))
