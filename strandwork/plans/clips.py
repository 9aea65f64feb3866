"""Registered queries over clips: an order's lines are a clip's sticks, a user's events its frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.operators import clips
from strandwork.plans.catalog import EV, registered, user_frames
from strandwork.session import table

ST = """lines AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS l_linenumber) FROM lineitem),
st AS (
  SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS source_index, l_partkey % 100 AS top_x, l_suppkey % 50 AS top_y,
         cast(l_quantity AS BIGINT) AS bottom_x, cast(floor(l_extendedprice) AS BIGINT) % 100 AS bottom_y,
         l_suppkey % 3 = 0 AS manual, (l_partkey % 100) / 100::DOUBLE AS phase
  FROM lines)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines numbered anew: a number may stand twice in an order."""
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.row_number().over(by).cast("long"))


def sticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        "l_orderkey",
        F.col("l_linenumber").alias("order"),
        (F.col("l_linenumber") - 1).alias("source_index"),
        (F.col("l_partkey") % 100).alias("top_x"),
        (F.col("l_suppkey") % 50).alias("top_y"),
        F.col("l_quantity").cast("long").alias("bottom_x"),
        (F.floor("l_extendedprice") % 100).alias("bottom_y"),
        (F.col("l_suppkey") % 3 == 0).alias("manual"),
        ((F.col("l_partkey") % 100) / 100).alias("phase"),
    )


@registered("stick_travel", f"""WITH {ST},
d AS (SELECT *, top_x - lag(top_x) OVER w AS tx, top_y - lag(top_y) OVER w AS ty, bottom_x - lag(bottom_x) OVER w AS bx, bottom_y - lag(bottom_y) OVER w AS by_
      FROM st WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, coalesce(sum(cast(floor(sqrt(((tx + bx) / 2) ** 2 + ((ty + by_) / 2) ** 2) * 1000 + 0.5) AS BIGINT)), 0)::BIGINT AS centre_milli,
       coalesce(sum(cast(floor(greatest(sqrt(tx ** 2 + ty ** 2), sqrt(bx ** 2 + by_ ** 2)) * 1000 + 0.5) AS BIGINT)), 0)::BIGINT AS edge_milli
FROM d GROUP BY l_orderkey""")
def stick_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.travel(sticks(spark, sf_dir), ["l_orderkey"])


@registered("phase_spread", f"""WITH {ST},
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM st),
b AS (SELECT *,
        (SELECT max(i) FROM n o WHERE o.l_orderkey = n.l_orderkey AND o.manual AND o.i < n.i) AS li,
        (SELECT min(i) FROM n o WHERE o.l_orderkey = n.l_orderkey AND o.manual AND o.i > n.i) AS hi FROM n),
v AS (SELECT b.*, coalesce(l.phase, 0) AS low, coalesce(h.phase, 1) AS high, coalesce(li, -1) AS l_i, coalesce(hi, b.n) AS h_i
      FROM b LEFT JOIN n l ON l.l_orderkey = b.l_orderkey AND l.i = b.li LEFT JOIN n h ON h.l_orderkey = b.l_orderkey AND h.i = b.hi),
p AS (SELECT *, CASE WHEN manual THEN phase ELSE low + (high - low) * (i - l_i) / (h_i - l_i) END AS p FROM v)
SELECT l_orderkey, l_linenumber AS "order", manual,
       cast(floor((i * 0.0001::DOUBLE + least(1 - (n - 1) * 0.0001::DOUBLE,
         greatest(0, max(p - i * 0.0001::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY i)))) * 1e6 + 0.5) AS BIGINT) AS phase_micro
FROM p""")
def phase_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clips.spread_phases(sticks(spark, sf_dir), ["l_orderkey"])
    return out.select("l_orderkey", "order", "manual", F.floor(F.col("phase") * 1e6 + 0.5).cast("long").alias("phase_micro"))


@registered("stick_remap", f"""WITH {ST},
q AS (SELECT l_orderkey, l_linenumber AS frame, (l_linenumber * 3) % 7 AS new_index FROM lines
      UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber + 10 FROM lines WHERE l_linenumber % 2 = 0)
SELECT st.l_orderkey, q.new_index::BIGINT AS frame, source_index::BIGINT AS source_index,
       row_number() OVER (PARTITION BY st.l_orderkey, manual ORDER BY q.new_index, phase, l_linenumber, source_index) - 1 AS "order", manual
FROM st JOIN q ON q.l_orderkey = st.l_orderkey AND q.frame = st.l_linenumber""")
def stick_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sticks(spark, sf_dir).withColumn("frame", F.col("order"))
    n = F.col("l_linenumber")
    places = F.array_compact(F.array(n * 3 % 7, F.when(n % 2 == 0, n + 10)))
    plan = lines(spark, sf_dir).select("l_orderkey", n.alias("source_index"), F.explode(places).alias("new_index"))
    out = clips.remap_sticks(s, plan, ["l_orderkey"], "manual")
    return out.select("l_orderkey", "frame", F.col("source_index").cast("long").alias("source_index"), "order", "manual")


AT = """f AS (SELECT DISTINCT 'c' || (o_custkey % 50) || '/' || o_orderstatus AS binding, o_orderstatus AS animation, o_orderkey % 20 AS frame FROM orders),
a AS (SELECT p_partkey AS attachment_id,
        CASE p_partkey % 4 WHEN 0 THEN 'c' || (p_size % 50) || '/F:' || (p_partkey % 20) WHEN 1 THEN 'a:b:c1:d:O:e:' || (p_partkey % 20) ELSE '' END AS key,
        CASE WHEN p_partkey % 4 = 2 THEN CASE WHEN p_size % 2 = 0 THEN 'P' ELSE 'c3/O' END ELSE '' END AS meta_animation, p_partkey % 20 AS meta_frame FROM part),
n AS (SELECT *, CASE p_kind WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE '' END AS named FROM (SELECT *, attachment_id % 4 AS p_kind FROM a)),
c AS (SELECT *, CASE WHEN meta_animation <> '' THEN meta_animation ELSE named END AS clip FROM n)"""


@registered("frame_attachments", f"""WITH {AT}
SELECT DISTINCT binding, animation, frame, attachment_id
FROM f JOIN c ON c.key = binding || ':' || frame OR (c.meta_frame = frame AND (clip = '' OR clip = binding OR clip = animation OR named = animation))""")
def frame_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 50, F.lit("/"), "o_orderstatus").alias("binding"), F.col("o_orderstatus").alias("animation"), (F.col("o_orderkey") % 20).alias("frame"))
    k, n = F.col("p_partkey") % 4, (F.col("p_partkey") % 20).cast("string")
    key = F.when(k == 0, F.concat(F.lit("c"), F.col("p_size") % 50, F.lit("/F:"), n)).when(k == 1, F.concat(F.lit("a:b:c1:d:O:e:"), n)).otherwise("")
    meta = F.when(k == 2, F.when(F.col("p_size") % 2 == 0, "P").otherwise("c3/O")).otherwise("")
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("attachment_id"), key.alias("key"), meta.alias("meta_animation"), (F.col("p_partkey") % 20).alias("meta_frame"))
    return clips.attachments_of(o, a)


_NAMES = ["Walk", "Idle_2", "Sword Attack", "run_jump", "攻击", "Fire ball", "standing"]
_NAME_SQL = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("name", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 7 + 1).cast("int")))


@registered("source_height", f"""WITH s AS (
  SELECT p_brand, p_type, p_partkey, {_NAME_SQL} AS name, p_size + p_partkey % 30 AS height FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM s),
u AS (SELECT *, NOT regexp_matches(lower(name), 'attack|atk|slash|strike|slide|dash|jump|air|fall|hurt|death|crouch|roll')
             AND regexp_matches(lower(name), 'idle|stand|walk|run') AS up FROM r WHERE r <= 4 AND height >= 16),
k AS (SELECT *, bool_or(up) OVER (PARTITION BY p_brand) AS any_up FROM u),
i AS (SELECT p_brand, height, row_number() OVER (PARTITION BY p_brand ORDER BY height, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM k WHERE up OR NOT any_up)
SELECT p_brand, height AS source_height, n AS samples FROM i WHERE i = floor((n - 1) * 0.5 + 0.5)""")
def source_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _named(spark, sf_dir).select("p_brand", "p_type", "p_partkey", "name", (F.col("p_size") + F.col("p_partkey") % 30).alias("height"))
    return clips.source_height(p, ["p_brand"], "p_type", "name", "height", ["p_partkey"])


@registered("clip_predicates", f"""WITH s AS (SELECT p_partkey, p_size, p_retailprice, {_NAME_SQL} AS name, p_partkey % 11 AS frame FROM part)
SELECT p_partkey, regexp_matches(lower(name), '(^|[\\s_-])(attack|atk|slash|strike|shoot|shot|fire|skill|cast|stab|punch|kick|bite|claw|parry|counter)($|[\\s_-]|[0-9])') OR name = '攻击' AS attack,
       NOT regexp_matches(lower(name), 'attack|atk|slash|strike|slide|dash|jump|air|fall|hurt|death|crouch|roll') AND regexp_matches(lower(name), 'idle|stand|walk|run') AS upright,
       regexp_matches(lower(name), 'shoot|shot|fire|cast|projectile|skill') OR ((frame + 1) / 11 >= 0.25 AND frame / 11 <= 0.85) AS hit,
       p_size % 9 > 0 AND p_partkey % 9 > 0 AS box_ok
FROM s""")
def clip_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, name = _named(spark, sf_dir), F.col("name")
    return p.select(
        "p_partkey",
        clips.looks_attack(name).alias("attack"),
        clips.looks_upright(name).alias("upright"),
        clips.hit_enabled(F.col("p_partkey") % 11, F.lit(11), name).alias("hit"),
        clips.valid_box(F.col("p_size") % 9, F.col("p_partkey") % 9, F.col("p_retailprice"), F.lit(1.0)).alias("box_ok"),
    )


@registered("binding_audit", """WITH t AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority < '3' GROUP BY o_custkey)
SELECT coalesce(t.o_custkey, m.o_custkey) AS o_custkey, t.n AS n_trails, m.n AS n_manifest,
       CASE WHEN m.n IS NULL THEN 'unexpected' WHEN t.n IS NULL THEN 'missing' ELSE 'count mismatch' END AS issue
FROM t FULL JOIN m ON t.o_custkey = m.o_custkey WHERE t.n IS DISTINCT FROM m.n""")
def binding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda c: o.where(c).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return clips.binding_audit(side("o_orderstatus = 'F'"), side("o_orderpriority < '3'"), ["o_custkey"])


_THERE = "SELECT DISTINCT c_nationkey, 'w' || CASE c_custkey % 3 WHEN 0 THEN '' ELSE '_' || (c_custkey % 3 * 2) END AS name, 'old' AS made FROM customer"
_NEW = "SELECT DISTINCT c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'w' ELSE 'x' END AS name, 'new' AS made FROM customer"


def _clips_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    there = c.select("c_nationkey", F.concat(F.lit("w"), F.when(k == 0, "").otherwise(F.concat(F.lit("_"), (k * 2).cast("string")))).alias("name"), F.lit("old").alias("made")).distinct()
    return there, c.select("c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "w").otherwise("x").alias("name"), F.lit("new").alias("made")).distinct()


@registered("import_renamed", f"""WITH t AS ({_THERE}), n AS ({_NEW}),
u AS (SELECT c_nationkey, list(name) AS names FROM t GROUP BY c_nationkey)
SELECT * FROM t UNION ALL
SELECT n.c_nationkey, CASE WHEN name = 'w' AND list_contains(names, 'w') THEN
    CASE WHEN NOT list_contains(names, 'w_2') THEN 'w_2' ELSE 'w_3' END ELSE name END, made
FROM n LEFT JOIN u ON u.c_nationkey = n.c_nationkey""")
def import_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.import_clips(*_clips_of(spark, sf_dir), ["c_nationkey"], "name")


@registered("import_replacing", f"""WITH t AS ({_THERE}), n AS ({_NEW})
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.c_nationkey = t.c_nationkey AND n.name = t.name) UNION ALL SELECT * FROM n""")
def import_replacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.import_clips(*_clips_of(spark, sf_dir), ["c_nationkey"], "name", replace=True)


@registered("removed_bindings", """SELECT l_returnflag, count(*) FILTER (o_orderstatus = 'F') AS removed, count(*) FILTER (o_orderstatus IS DISTINCT FROM 'F') AS kept
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_returnflag""")
def removed_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return clips.remove_bindings(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), gone, ["l_orderkey"], ["l_returnflag"])[1]


@registered("size_totals", """WITH f AS (SELECT l_returnflag, cast(l_quantity AS BIGINT) * 100 AS before, l_partkey % 6000 AS after FROM lineitem)
SELECT l_returnflag, count(*) AS files, sum(before)::BIGINT AS bytes_before, sum(least(before, after))::BIGINT AS bytes_after,
       sum(before - least(before, after))::BIGINT AS bytes_saved FROM f GROUP BY l_returnflag""")
def size_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity").cast("long") * 100).alias("before"), (F.col("l_partkey") % 6000).alias("after"))
    return clips.size_totals(f, ["l_returnflag"], "before", "after")


@registered("refused_frames", f"""WITH {EV},
w AS (SELECT user_id, frame_index FROM e WHERE cents % 3 = 0 UNION ALL SELECT user_id, frame_index + 1 FROM e WHERE cents % 5 = 0),
t AS (SELECT user_id, frame_index, count(*) AS times FROM w GROUP BY ALL)
SELECT t.user_id, t.frame_index, CASE WHEN e.user_id IS NULL THEN 'out of range' ELSE 'duplicate' END AS reason
FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.frame_index = t.frame_index WHERE e.user_id IS NULL OR times > 1""")
def refused_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = user_frames(spark, sf_dir).select("user_id", F.col("frame_index").cast("long").alias("frame_index"), "cents")
    wanted = f.where("cents % 3 = 0").select("user_id", "frame_index").union(f.where("cents % 5 = 0").select("user_id", F.col("frame_index") + 1))
    return clips.strict_selection(f, ["user_id"], wanted)[1]


@registered("quality_issues", f"""WITH {EV},
m AS (SELECT user_id, frame_index, cents, length(props) AS len FROM e),
q AS (SELECT user_id, frame_index, cents % 11 AS box_height, abs(cents) % 40 + 10 AS body, len % 9 AS feet, abs(cents) % 23 AS centre,
             event % 7 AS holes, event % 6 AS white, event % 13 + 1 AS edges, event % 5 AS boundary
      FROM (SELECT m.*, abs(cents) // 3 AS event FROM m)),
r AS (SELECT user_id, list_sort(list(body))[count(*) // 2 + 1] AS rb, list_sort(list(feet))[count(*) // 2 + 1] AS rf, list_sort(list(centre))[count(*) // 2 + 1] AS rc FROM q GROUP BY user_id)
SELECT user_id, frame_index, concat_ws(',', CASE WHEN box_height = 0 THEN 'empty' END, CASE WHEN rb > 0 AND abs(body - rb) / rb > 0.2 THEN 'size_jump' END,
         CASE WHEN abs(feet - rf) > 3 THEN 'feet_drift' END, CASE WHEN abs(centre - rc) > 5 THEN 'center_drift' END, CASE WHEN holes >= 4 THEN 'alpha_holes' END,
         CASE WHEN white >= 4 AND white / edges > 0.25 THEN 'bright_edge' END, CASE WHEN boundary > 0 THEN 'touches_canvas_edge' END) AS issues
FROM q JOIN r USING (user_id)""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, k = user_frames(spark, sf_dir), F.abs("cents")
    event = F.floor(k / 3)
    m = f.select(
        "user_id", F.col("frame_index").cast("long").alias("frame_index"), (F.col("cents") % 11).alias("box_height"), (k % 40 + 10).alias("body_height"), (F.length("props") % 9).alias("feet"), (k % 23).alias("centre"),
        (event % 7).alias("hole_pixels"), (event % 6).alias("white_edge"), (event % 13 + 1).alias("edge_pixels"), (event % 5).alias("boundary"),
    )
    return clips.quality_issues(m, ["user_id"]).select("user_id", "frame_index", F.array_join("issues", ",").alias("issues"))
