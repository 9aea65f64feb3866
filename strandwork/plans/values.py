"""Registered queries over column functions and small sequence rules, each with its SQL: remaps, scales, sweeps, holds at
a suggested threshold, key modes, colours, numbers, names and grid steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions import color, text
from strandwork.operators import documents, loops, sequences, spatial, timeline
from strandwork.plans.catalog import EV, LIN, OR, RGB, C, U, order_frames, part_colours, registered, user_frames
from strandwork.session import table

COLOURS = RGB.replace("cast(p_retailprice AS BIGINT)", "cast(floor(p_retailprice) AS BIGINT)")


def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


def scaled(column, factor: float):
    """A whole number of parts, halves up."""
    return F.floor(column * factor + 0.5).cast("long")


@registered("reference_remap", f"""WITH {OR},
n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM o),
q AS (SELECT o_custkey, n - 1 - frame_index AS new_index, frame_index AS old_index FROM n WHERE frame_index % 3 <> 1
      UNION ALL SELECT o_custkey, n, frame_index FROM n WHERE frame_index = 0),
f AS (SELECT o_custkey, old_index, min(new_index) AS new_reference FROM q GROUP BY ALL)
SELECT o.o_custkey, o.frame_index AS reference, new_reference FROM o LEFT JOIN f ON f.o_custkey = o.o_custkey AND f.old_index = o.frame_index""")
def reference_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as a reference, after an order that runs backwards, leaves every third out and repeats the first."""
    seq = order_frames(spark, sf_dir).select("o_custkey", "frame_index")
    n = seq.withColumn("n", F.count("*").over(W.partitionBy("o_custkey")))
    back = F.struct((F.col("n") - 1 - F.col("frame_index")).alias("new_index"))
    again = F.when(F.col("frame_index") == 0, F.struct(F.col("n").alias("new_index")))
    order = n.where("frame_index % 3 <> 1").select("o_custkey", F.col("frame_index").alias("old_index"), F.explode(F.array_compact(F.array(back, again))).alias("x"))
    order = order.select("o_custkey", "old_index", "x.new_index")
    return documents.reference_remap(seq.withColumnRenamed("frame_index", "reference"), order, C, "reference")


@registered("frame_scales", f"""WITH {EV},
v AS (SELECT user_id, frame_index, (event_id % 7 - 2) / 2 AS scale FROM e WHERE event_id % 5 = 0)
SELECT e.user_id, e.frame_index, coalesce(CASE WHEN v.scale > 0 THEN v.scale END, CASE WHEN e.user_id % 3 > 0 THEN e.user_id % 3 END, 1.0)::DOUBLE AS scale
FROM e LEFT JOIN v ON v.user_id = e.user_id AND v.frame_index = e.frame_index""")
def frame_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = user_frames(spark, sf_dir)
    overrides = seq.where("event_id % 5 = 0").select("user_id", "frame_index", ((F.col("event_id") % 7 - 2) / 2).alias("scale"))
    return timeline.scales(seq.select("user_id", "frame_index"), overrides, ["user_id", "frame_index"], F.col("user_id") % 3).select("user_id", "frame_index", F.col("scale").cast("double").alias("scale"))


@registered("sweep_samples", f"""WITH {OR},
w AS (SELECT o_custkey, frame_index, frame_index * 0.125::DOUBLE AS arrival, (cents % 10 + 1) / 64 AS width FROM o),
s AS (SELECT *, greatest(1, ceil(width * 60))::BIGINT AS steps FROM w),
x AS (SELECT *, unnest(range(0, steps)) AS step FROM s)
SELECT o_custkey, frame_index, step, cast(floor((arrival + width * step / steps) * 1e6::DOUBLE + 0.5) AS BIGINT) AS time_micro,
       cast(floor(CASE WHEN width * step / steps < 0.15::DOUBLE THEN pow(1 - width * step / steps / 0.15::DOUBLE, 1.5::DOUBLE) ELSE 0 END * 1e6::DOUBLE + 0.5) AS BIGINT) AS opacity_micro
FROM x""")
def sweep_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each order's sweep and their opacity after the time since its start."""
    arrival = F.col("frame_index") * 0.125
    spans = order_frames(spark, sf_dir).select("o_custkey", "frame_index", arrival.alias("arrival"), (arrival + (F.col("cents") % 10 + 1) / 64).alias("next_arrival"))
    out = timeline.sweep_samples(spans, ["o_custkey", "frame_index"])
    opacity = timeline.fade(F.col("time") - F.col("arrival"), 0.15)
    return out.select("o_custkey", "frame_index", F.col("step").cast("long").alias("step"), scaled(F.col("time"), 1e6).alias("time_micro"), scaled(opacity, 1e6).alias("opacity_micro"))


_NEAR = "greatest(0.0::DOUBLE, 100 - abs({0} - {1}) * 1.0::DOUBLE)"


def _held(name: str, users: str) -> str:
    """SQL: the fold of holds, one frame after the other, at each user's threshold t."""
    return f"""{name}(user_id, t, i, anchor, anchor_cents, cents, held) AS (
  SELECT e.user_id, u.t, 0::BIGINT, 0::BIGINT, cents, cents, false FROM e JOIN ({users}) u ON u.user_id = e.user_id WHERE frame_index = 0
  UNION ALL
  SELECT f.user_id, f.t, f.i + 1, CASE WHEN x.held THEN f.anchor ELSE f.i + 1 END, CASE WHEN x.held THEN f.anchor_cents ELSE x.cents END, x.cents, x.held
  FROM {name} f JOIN LATERAL (
    SELECT e.cents, {_NEAR.format('f.cents', 'e.cents')} >= f.t AND {_NEAR.format('f.anchor_cents', 'e.cents')} >= f.t AS held
    FROM e WHERE e.user_id = f.user_id AND e.frame_index = f.i + 1) x ON true)"""


@registered("suggested_holds", f"""WITH RECURSIVE {EV},
n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id),
{_held('f', 'SELECT user_id, 88.0::DOUBLE AS t FROM n WHERE n >= 3')},
near AS (SELECT user_id, floor(max(s)) AS low FROM (
  SELECT user_id, {_NEAR.format('cents', 'lag(cents) OVER (PARTITION BY user_id ORDER BY frame_index)')} AS s, frame_index FROM e) WHERE frame_index > 0 GROUP BY user_id),
lower_ AS (SELECT near.user_id, low::DOUBLE AS t FROM near JOIN n USING (user_id) WHERE low > 55 AND low < 88 AND user_id NOT IN (SELECT user_id FROM f WHERE held)),
{_held('m', 'SELECT * FROM lower_ WHERE user_id IN (SELECT user_id FROM n WHERE n >= 3)')},
d AS (SELECT *, i - lag(i) OVER (PARTITION BY user_id ORDER BY i) AS gap FROM m WHERE held),
z AS (SELECT user_id FROM d JOIN n USING (user_id) GROUP BY user_id, n
      HAVING count(*) >= 3 AND n >= 4 AND count(DISTINCT gap) = 1 AND count(*) >= (n - 1) // 2)
SELECT user_id, i AS frame_index, anchor AS match_index, t AS threshold FROM f WHERE held
UNION ALL SELECT user_id, i, anchor, t FROM m WHERE held AND user_id NOT IN (SELECT user_id FROM z)""")
def suggested_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.duplicate_holds(user_frames(spark, sf_dir), U, "cents", 88.0, suggest=True)


@registered("keyframe_modes", f"""WITH {EV},
k AS (SELECT user_id, frame_index * 4 AS frame, cents::DOUBLE AS v, cents / 1000 AS turn, lead(frame_index * 4) OVER w AS nf, lead(cents::DOUBLE) OVER w AS nv, lead(cents / 1000) OVER w AS nt
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
x AS (SELECT *, unnest(range(frame, coalesce(nf - 1, frame) + 1)) AS pos FROM k),
t AS (SELECT *, CASE WHEN nf IS NULL THEN 0.0::DOUBLE ELSE (pos - frame)::DOUBLE / (nf - frame) END AS s, coalesce(nt - turn, 0.0) + pi() AS way FROM x),
m AS (SELECT *, s * s * (3 - 2 * s) AS s3, way - floor(way / (2 * pi())) * (2 * pi()) - pi() AS short FROM t)
SELECT user_id, pos AS frame, 'smooth' AS mode, cast(floor((v + coalesce(nv - v, 0.0) * s3) * 1000 + 0.5) AS BIGINT) AS v_milli,
       cast(floor((turn + CASE WHEN s3 = 0 THEN 0.0 ELSE short * s3 END) * 1e5::DOUBLE + 0.5) AS BIGINT) AS turn_parts FROM m
UNION ALL SELECT user_id, pos, 'hold', cast(floor(v * 1000 + 0.5) AS BIGINT), cast(floor(turn * 1e5::DOUBLE + 0.5) AS BIGINT) FROM m""")
def keyframe_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values and turns as keys four frames apart, smooth and held."""
    keys = user_frames(spark, sf_dir).select("user_id", (F.col("frame_index") * 4).alias("frame"), F.col("cents").cast("double").alias("v"), (F.col("cents") / 1000).alias("turn"))
    out = None
    for mode in ("smooth", "hold"):
        one = timeline.interpolate(keys, U, ["v"], "turn", mode=mode)
        one = one.select("user_id", "frame", F.lit(mode).alias("mode"), scaled(F.col("v"), 1000).alias("v_milli"), scaled(F.col("turn"), 1e5).alias("turn_parts"))
        out = one if out is None else out.union(one)
    return out


_HEX = "strpos('0123456789abcdef', substr(t, {0}, 1)) - 1"


@registered("hex_colours", f"""WITH {COLOURS},
h AS (SELECT p_partkey, '#' || {" || ".join(f"lpad(lower(to_hex({c})), 2, '0')" for c in "rgb")} AS hex FROM c),
w AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN hex WHEN 1 THEN substr(hex, 2, 3) WHEN 2 THEN upper(hex) ELSE hex || '0' END AS written FROM h),
k AS (SELECT *, CASE WHEN regexp_full_match(written, '#?([0-9A-Fa-f]{{6}}|[0-9A-Fa-f]{{3}})') THEN ltrim(lower(written), '#') END AS u FROM w),
f AS (SELECT *, CASE WHEN length(u) = 3 THEN regexp_replace(u, '(.)', '\\1\\1', 'g') ELSE u END AS t FROM k)
SELECT p_partkey, hex, written, {", ".join(f"(16 * ({_HEX.format(2 * i + 1)}) + {_HEX.format(2 * i + 2)})::INT AS {c}" for i, c in enumerate("rgb"))} FROM f""")
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's colour written in one of four ways, the last of which is none, and read again."""
    c = part_colours(spark, sf_dir).select("p_partkey", color.rgb_to_hex(*_rgb()).alias("hex"))
    k = F.col("p_partkey") % 4
    written = F.when(k == 0, F.col("hex")).when(k == 1, F.substring("hex", 2, 3)).when(k == 2, F.upper("hex")).otherwise(F.concat("hex", F.lit("0")))
    c = c.withColumn("written", written).withColumn("x", color.hex_to_rgb(F.col("written")))
    return c.select("p_partkey", "hex", "written", *[F.col("x")[i].alias(n) for i, n in enumerate("rgb")])


@registered("hue_and_skin", f"""WITH {COLOURS},
d AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d FROM c),
s AS (SELECT *, CASE WHEN d = 0 THEN 0.0 WHEN top = r THEN (g - b) / d * 60 WHEN top = g THEN ((b - r) / d + 2) * 60 ELSE ((r - g) / d + 4) * 60 END AS sector FROM d),
h AS (SELECT *, CASE WHEN sector < 0 THEN sector + 360 ELSE sector END AS h FROM s)
SELECT p_partkey, cast(floor(h * 1000 + 0.5) AS BIGINT) AS hue_milli, cast(floor(CASE WHEN top = 0 THEN 0.0 ELSE d / top END * 1000 + 0.5) AS BIGINT) AS saturation_milli,
       cast(floor(top / 255 * 1000 + 0.5) AS BIGINT) AS value_milli, cast(floor(least(abs(h - 200), 360 - abs(h - 200)) * 1000 + 0.5) AS BIGINT) AS from_200_milli,
       cast(floor((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) * 1000 + 0.5) AS BIGINT) AS luma_milli,
       r > 45 AND g > 22 AND b > 12 AND r > g * 1.12::DOUBLE AND g > b * 1.06::DOUBLE AND r - b > 18 AND r - g < 135 AS skin, r::INT AS red_again
FROM h""")
def hue_and_skin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = part_colours(spark, sf_dir).withColumn("x", color.hsv(*_rgb()))
    return c.select(
        "p_partkey",
        scaled(F.col("x.h"), 1000).alias("hue_milli"),
        scaled(F.col("x.s"), 1000).alias("saturation_milli"),
        scaled(F.col("x.v"), 1000).alias("value_milli"),
        scaled(color.hue_distance(F.col("x.h"), F.lit(200)), 1000).alias("from_200_milli"),
        scaled(color.luma(*_rgb()), 1000).alias("luma_milli"),
        color.skin(*_rgb()).alias("skin"),
        color.linear_to_srgb(color.srgb_to_linear(F.col("r"))).alias("red_again"),
    )


def _lab_sql(source: str, name: str) -> str:
    """SQL: name(p_partkey, r, g, b, l, a, bb) with the OKLab of source's colours, from the fixed matrices."""
    dot = lambda row, xs: " + ".join(f"{x} * {w!r}::DOUBLE" for w, x in zip(row, xs, strict=True))
    lms = ", ".join(f"cbrt({dot(row, ('lr', 'lg', 'lb'))}) AS {n}" for row, n in zip(color.TO_LMS, "xyz", strict=True))
    lab = ", ".join(f"{dot(row, 'xyz')} AS {n}" for row, n in zip(color.TO_LAB, ("l", "a", "bb"), strict=True))
    linear = ", ".join(f"{LIN.format(n)} AS l{n}" for n in "rgb")
    return f"{name} AS (SELECT p_partkey, r, g, b, {lab} FROM (SELECT *, {lms} FROM (SELECT *, {linear} FROM {source})))"


_CHROMA = [" + ".join(f"(u.{c} - w.{c}) / 255 * {k!r}::DOUBLE" for k, c in zip(row, "rgb", strict=True)) for row in color.TO_CHROMA]


@registered("perceptual_distance", f"""WITH {COLOURS}, one AS (SELECT 0 AS p_partkey, 30 AS r, 180 AS g, 90 AS b),
{_lab_sql('c', 'u')}, {_lab_sql('one', 'w')},
d AS (SELECT u.p_partkey, u.l AS ul, w.l AS wl,
        least(greatest(sqrt((2 + (u.r + w.r) / 2 / 256) * (u.r - w.r) ** 2 + 4 * (u.g - w.g) ** 2 + (2 + (255 - (u.r + w.r) / 2) / 256) * (u.b - w.b) ** 2) / 764.834::DOUBLE * 100, 0), 100) AS red,
        least(sqrt(({_CHROMA[0]}) ** 2 + ({_CHROMA[1]}) ** 2) / 0.7072::DOUBLE * 100, 100) AS chroma,
        least(sqrt((u.l - w.l) ** 2 + (u.a - w.a) ** 2 + (u.bb - w.bb) ** 2) / 0.8::DOUBLE * 100, 100) AS lab,
        sqrt(u.a ** 2 + u.bb ** 2) > 0.035::DOUBLE AND sqrt(w.a ** 2 + w.bb ** 2) > 0.035::DOUBLE AS vivid,
        abs(degrees(atan2(u.bb, u.a)) - degrees(atan2(w.bb, w.a))) % 360 AS turn FROM u, w),
m AS (SELECT *, red * 0.22::DOUBLE + chroma * 0.46::DOUBLE + lab * 0.32::DOUBLE AS mix, least(turn, 360 - turn) AS apart FROM d)
SELECT p_partkey, cast(floor(least(greatest(mix + CASE WHEN vivid AND apart > 15 THEN least((apart - 15) / 30 * 24, 24) ELSE 0 END
         + CASE WHEN ul < 0.22::DOUBLE AND wl > 0.32::DOUBLE THEN 28 ELSE 0 END, 0), 100) * 10000 + 0.5) AS BIGINT) AS distance FROM m""")
def perceptual_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = color.perceptual_distance(list(_rgb()), [F.lit(30), F.lit(180), F.lit(90)])
    return part_colours(spark, sf_dir).select("p_partkey", scaled(far, 10000).alias("distance"))


@registered("parsed_numbers", """WITH t AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '/' || (p_partkey % 5) WHEN 1 THEN ' ' || p_size || '.5 ' WHEN 2 THEN 'x' || p_size WHEN 3 THEN '' WHEN 4 THEN p_size || ' / 0' ELSE '-' || p_size END AS written FROM part)
SELECT p_partkey, written, CASE WHEN regexp_full_match(trim(written), '\\d+\\s*/\\s*\\d+')
         THEN CASE WHEN split_part(written, '/', 2)::DOUBLE <> 0 THEN split_part(written, '/', 1)::DOUBLE / split_part(written, '/', 2)::DOUBLE END
         WHEN trim(written) <> '' THEN try_cast(trim(written) AS DOUBLE) END AS parsed FROM t""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    forms = [F.concat(size, F.lit("/"), F.col("p_partkey") % 5), F.concat(F.lit(" "), size, F.lit(".5 ")), F.concat(F.lit("x"), size), F.lit(""), F.concat(size, F.lit(" / 0"))]
    written = F.concat(F.lit("-"), size)
    for i, form in enumerate(forms):
        written = F.when(k == i, form).otherwise(written)
    t = table(spark, sf_dir, "part").select("p_partkey", written.alias("written"))
    return t.withColumn("parsed", text.parse_number(F.col("written")))


_MESSY = """CASE p_partkey % 5 WHEN 0 THEN p_name || ' / ' || p_type WHEN 1 THEN '..' WHEN 2 THEN ' ' || p_brand || '?*' WHEN 3 THEN 'heroOne/WalkFast:' || p_size ELSE 'a/b/c:' || p_size || ':x' END"""


@registered("names_and_keys", f"""WITH t AS (SELECT p_partkey, p_type, {_MESSY} AS written FROM part),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(written), '[/\\\\]', '-', 'g'), '[<>:"|?*\\x00-\\x1F]|\\s+|\\.\\.', '_', 'g'), '^_+|_+$', '', 'g') AS u,
             regexp_matches(written, '^[^/]+/.+:\\d+$') AS ok FROM t)
SELECT p_partkey, written, CASE WHEN regexp_full_match(u, '\\.*') THEN 'project' ELSE u END AS slug, lower(regexp_replace(written, '([A-Z])', '_\\1', 'g')) AS snake,
       CASE WHEN ok THEN regexp_extract(written, '^([^/]+)/(.+):(\\d+)$', 1) END AS profile, CASE WHEN ok THEN regexp_extract(written, '^([^/]+)/(.+):(\\d+)$', 2) END AS animation,
       CASE WHEN ok THEN regexp_extract(written, '^([^/]+)/(.+):(\\d+)$', 3)::INT END AS frame FROM s""")
def names_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    written = (
        F.when(k == 0, F.concat("p_name", F.lit(" / "), "p_type"))
        .when(k == 1, "..")
        .when(k == 2, F.concat(F.lit(" "), "p_brand", F.lit("?*")))
        .when(k == 3, F.concat(F.lit("heroOne/WalkFast:"), size))
        .otherwise(F.concat(F.lit("a/b/c:"), size, F.lit(":x")))
    )
    t = table(spark, sf_dir, "part").select("p_partkey", written.alias("written"))
    w = F.col("written")
    return t.select("p_partkey", "written", text.slug(w).alias("slug"), text.snake_case(w).alias("snake"), text.binding_key(w).alias("k")).select("p_partkey", "written", "slug", "snake", "k.*")


@registered("grid_steps", """WITH w AS (SELECT p_partkey, greatest(1.0::DOUBLE, greatest(1, p_partkey)::DOUBLE / greatest(1, p_size) * greatest(1, p_size) / 5) AS want FROM part),
b AS (SELECT *, pow(10.0::DOUBLE, floor(log10(want))) AS base FROM w)
SELECT p_partkey, cast(CASE WHEN base >= want THEN base WHEN base * 2 >= want THEN base * 2 WHEN base * 5 >= want THEN base * 5 ELSE base * 10 END AS DOUBLE) AS step FROM b""")
def grid_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", spatial.grid_step(F.col("p_size"), F.col("p_partkey")).alias("step"))


@registered("loop_advice", """WITH t AS (
  SELECT p_partkey, p_size AS frames, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 10 / 10 END AS coverage, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 24 END AS length,
         CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 24 ELSE p_partkey % 12 END AS period, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 11 / 10 END AS smoothness,
         CASE WHEN p_partkey % 6 > 0 THEN (p_partkey % 101)::DOUBLE END AS similarity, CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 9 / 10 END AS score FROM part),
s AS (SELECT *, coalesce(period = length AND length >= 12 AND (coalesce(smoothness >= 0.7::DOUBLE, false) OR coalesce(similarity >= 70, false) OR coalesce(score >= 0.45::DOUBLE, false)), false) AS solid FROM t)
SELECT p_partkey, CASE WHEN score IS NULL THEN true WHEN frames < 12 OR solid THEN false ELSE (coverage IS NULL OR coverage < 0.5::DOUBLE) AND (length IS NULL OR length < 12) END AS one_shot FROM s""")
def loop_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    gone = lambda every, x: F.when(k % every > 0, x)
    likely = loops.one_shot_likely(F.col("p_size"), gone(5, k % 10 / 10), gone(7, k % 24), F.when(k % 3 > 0, k % 24).otherwise(k % 12), gone(4, k % 11 / 10), gone(6, (k % 101).cast("double")), gone(13, k % 9 / 10))
    return table(spark, sf_dir, "part").select("p_partkey", likely.alias("one_shot"))
