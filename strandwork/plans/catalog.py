"""Registered queries: the sequence and document operators over the given tables, each with its SQL oracle.

A user's events in time order are a sequence whose measure is the value in hundredths; a customer's orders are another.
Measures are integers wherever they are summed, so that results don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions import color, text
from strandwork.functions.medians import ranked_columns, upper_medians
from strandwork.operators import documents, loops, sequences, spatial, timeline
from strandwork.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


U = ["user_id"]
C = ["o_custkey"]
CLOSE = sequences.closeness(0.01)

EV = """e AS (
  SELECT user_id, event_id, ts, event_type, props, cast(floor(value * 100 + 0.5) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index
  FROM events)"""
OR = """o AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority,
         cast(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS frame_index
  FROM orders)"""


def cents(column: str):
    return F.floor(F.col(column) * 100 + 0.5).cast("long")


def user_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "props", cents("value").alias("cents"))
    return sequences.ordered(ev, U, ["ts", "event_id"]).withColumn("frame_index", F.col("frame_index").cast("long"))


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", cents("o_totalprice").alias("cents"))
    return sequences.ordered(o, C, ["o_orderdate", "o_orderkey"]).withColumn("frame_index", F.col("frame_index").cast("long"))


@registered(
    "quality_flags",
    """
WITH s AS (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index
  FROM events),
m AS (SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS reference FROM s GROUP BY user_id)
SELECT s.user_id, s.frame_index, s.value, m.reference,
       CASE WHEN s.value > m.reference THEN 'high' ELSE 'low' END AS issue
FROM s JOIN m USING (user_id)
WHERE abs(s.value - m.reference) > 0.8 * greatest(abs(m.reference), 1)
""",
)
def quality_flags(spark: SparkSession, sf_dir: str, tolerance: float = 0.8) -> DataFrame:
    """Rows of each user's sequence that deviate from the sequence's upper median by more than the tolerance."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    seq = ev.withColumn("frame_index", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    ref = upper_medians(ev, ["user_id"], "value").withColumnRenamed("middle", "reference")
    return (
        seq.join(ref, "user_id")
        .where(F.abs(F.col("value") - F.col("reference")) > tolerance * F.greatest(F.abs("reference"), F.lit(1.0)))
        .select(
            "user_id",
            F.col("frame_index").cast("long").alias("frame_index"),
            "value",
            "reference",
            F.when(F.col("value") > F.col("reference"), "high").otherwise("low").alias("issue"),
        )
    )


@registered("sequence_measure", f"""WITH {EV}
SELECT user_id, frame_index, cents, cents - first_value(cents) OVER w AS first_delta, coalesce(cents - lag(cents) OVER w, 0) AS step_delta
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)""")
def sequence_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.deltas(user_frames(spark, sf_dir).select("user_id", "frame_index", "cents"), U, "cents").fillna(0, ["step_delta"])


@registered("project_summary", """
SELECT r_name, count(DISTINCT n_nationkey) AS profiles, count(DISTINCT c_custkey) AS animations, count(o_orderkey) AS frames
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
     LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name""")
def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts at three levels; orders are counted per customer first, so no distinct count meets them."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    customers = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    per_nation = customers.groupBy("c_nationkey").agg(F.count("c_custkey").alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("f"))
    nations = table(spark, sf_dir, "nation").join(per_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = table(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return joined.groupBy("r_name").agg(F.count("n_nationkey").alias("profiles"), zero("a")("animations"), zero("f")("frames"))


@registered("medians", f"""WITH {EV}
SELECT event_type, median(cents) AS median_mid, list_sort(list(cents))[count(*) // 2 + 1] AS median_upper,
       list_sort(list(cents) FILTER (cents > 0))[cast(floor((count(*) FILTER (cents > 0) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS percentile_nearest
FROM e GROUP BY event_type""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_type", cents("value").alias("cents"))
    ev = ev.withColumn("positive", F.when(F.col("cents") > 0, F.col("cents")))
    found = ranked_columns(ev, ["event_type"], {
        "lower": ("cents", lambda n: F.floor((n - 1) / 2)), "median_upper": ("cents", lambda n: F.floor(n / 2)),
        "percentile_nearest": ("positive", lambda n: F.floor((n - 1) * 0.9 + 0.5)),
    })
    return found.select("event_type", ((F.col("lower") + F.col("median_upper")) / 2).alias("median_mid"), "median_upper", "percentile_nearest")


@registered("motion_window", f"""WITH {EV},
f AS (SELECT user_id, frame_index, cents, length(props) AS size,
             first_value(cents) OVER w AS c0, first_value(length(props)) OVER w AS s0,
             coalesce(abs(cents - lag(cents) OVER w), 0) + coalesce(abs(length(props) - lag(length(props)) OVER w), 0) AS step
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
m AS (SELECT *, abs(cents - c0) <= greatest(1.0, greatest(abs(cents), abs(c0)) * 0.08::DOUBLE)
             AND abs(size - s0) <= greatest(1.0, greatest(abs(size), abs(s0)) * 0.08::DOUBLE) AS rest FROM f),
a AS (SELECT user_id, min(frame_index) FILTER (NOT rest) AS first_moved, max(frame_index) FILTER (NOT rest) AS last_moved,
             max(frame_index) AS last_frame, arg_max(rest, frame_index) AS back, sum(step)::BIGINT AS activity FROM m GROUP BY user_id)
SELECT user_id, coalesce(first_moved, 0) AS start_frame,
       CASE WHEN first_moved IS NULL OR NOT back THEN last_frame ELSE last_moved END AS end_frame, activity FROM a""")
def motion_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = user_frames(spark, sf_dir).withColumn("size", F.length("props").cast("long"))
    return sequences.motion_window(seq, U, ["cents", "size"])


@registered("visual_scale", f"""WITH {OR},
h AS (SELECT o_custkey, frame_index, greatest(1.0::DOUBLE, cents::DOUBLE) AS body_height,
             median(greatest(1.0::DOUBLE, cents::DOUBLE)) OVER (PARTITION BY o_custkey) AS native FROM o)
SELECT o_custkey, frame_index, body_height, CASE WHEN body_height * 1.12::DOUBLE < native THEN 'zoom' ELSE 'group' END AS reason,
       cast(floor(1e7::DOUBLE * 1000 / CASE WHEN body_height * 1.12::DOUBLE < native THEN body_height ELSE native END + 0.5) AS BIGINT) AS scale_milli
FROM h""")
def visual_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.visual_scales(order_frames(spark, sf_dir), C, "cents", 1e7)


@registered("duplicate_holds", f"""WITH RECURSIVE {EV},
n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id),
f(user_id, i, anchor, anchor_cents, cents, held) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, cents, cents, false FROM e WHERE frame_index = 0
  UNION ALL
  SELECT f.user_id, f.i + 1, CASE WHEN x.held THEN f.anchor ELSE f.i + 1 END, CASE WHEN x.held THEN f.anchor_cents ELSE x.cents END, x.cents, x.held
  FROM f JOIN LATERAL (
    SELECT e.cents, greatest(0.0, 100 - abs(f.cents - e.cents) * 0.01::DOUBLE) >= 88
                AND greatest(0.0, 100 - abs(f.anchor_cents - e.cents) * 0.01::DOUBLE) >= 88 AS held
    FROM e WHERE e.user_id = f.user_id AND e.frame_index = f.i + 1) x ON true)
SELECT f.user_id, i AS frame_index, anchor AS match_index, 88.0::DOUBLE AS threshold FROM f JOIN n USING (user_id) WHERE held AND n >= 3""")
def duplicate_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.duplicate_holds(user_frames(spark, sf_dir), U, "cents", 88.0, CLOSE)


@registered("jump_frames", f"""WITH {EV},
t AS (SELECT user_id, frame_index, lag(cents) OVER w AS b, cents AS n, lead(cents) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
s AS (SELECT user_id, frame_index, greatest(0.0::DOUBLE, 100 - abs(b - a) * 0.01::DOUBLE)
             - least(greatest(0.0::DOUBLE, 100 - abs(b - n) * 0.01::DOUBLE), greatest(0.0::DOUBLE, 100 - abs(n - a) * 0.01::DOUBLE)) AS score
      FROM t WHERE b IS NOT NULL AND a IS NOT NULL)
SELECT * FROM s WHERE score > 0 AND score >= 12""")
def jump_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.jump_frames(user_frames(spark, sf_dir), U, "cents", 88.0, CLOSE)


PAIRS = f"""{EV},
p AS (SELECT a.user_id, a.frame_index AS i, b.frame_index AS j, greatest(0.0::DOUBLE, 100 - abs(a.cents - b.cents) * 0.01::DOUBLE) AS similarity
      FROM e a JOIN e b ON a.user_id = b.user_id AND b.frame_index > a.frame_index AND b.frame_index <= a.frame_index + 8)"""


@registered("pair_similarity", f"WITH {PAIRS} SELECT * FROM p")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.pair_similarity(user_frames(spark, sf_dir), U, "cents", 8, CLOSE)


#: The lags of a sequence of n frames go up to two thirds of it.
LAGS = f"""{EV},
n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id),
g AS (SELECT a.user_id, n.n AS frames, b.frame_index - a.frame_index AS period, greatest(0.0::DOUBLE, 100 - abs(a.cents - b.cents) * 0.01::DOUBLE) AS similarity
      FROM e a JOIN n ON n.user_id = a.user_id JOIN e b ON a.user_id = b.user_id AND b.frame_index > a.frame_index
       AND b.frame_index - a.frame_index <= least(n.n - 1, n.n * 2 // 3))"""


@registered("autocorrelation", f"""WITH {LAGS}
SELECT user_id, period, sum(cast(floor(similarity * 100 + 0.5) AS BIGINT))::BIGINT AS similarity_sum, count(*) AS n FROM g GROUP BY ALL""")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.autocorrelation(user_frames(spark, sf_dir), U, "cents", CLOSE).drop("frames")


@registered("loop_candidates", f"""WITH {LAGS},
c AS (SELECT user_id, frames, period, cast(sum(cast(floor(similarity * 1e6::DOUBLE + 0.5) AS BIGINT))::DOUBLE / (count(*) * 1e8::DOUBLE) AS FLOAT)::DOUBLE AS acf
      FROM g WHERE period >= 2 AND frames >= 4 GROUP BY ALL),
h AS (SELECT x.user_id, x.frames, x.period, x.acf, cast(min(a.acf + (b.acf - a.acf) * (x.period - a.period) / greatest(1, b.period - a.period)) AS FLOAT)::DOUBLE AS base
      FROM c x JOIN c a ON a.user_id = x.user_id AND a.period <= x.period JOIN c b ON b.user_id = x.user_id AND b.period >= x.period GROUP BY ALL),
r AS (SELECT *, acf / greatest(base, 2.220446049250313e-16::DOUBLE) AS side FROM h),
k AS (SELECT *, lag(side) OVER w AS s0, lead(side) OVER w AS s2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY period)),
t AS (SELECT user_id, list([period] ORDER BY acf DESC, period) AS tops FROM k
      WHERE base > 0 AND side > 1 AND (s0 IS NULL OR side >= s0) AND (s2 IS NULL OR side >= s2) GROUP BY user_id),
u AS (SELECT user_id, unnest(list_reduce(tops, lambda acc, p: CASE WHEN len(list_filter(acc, lambda q: abs(q - p[1]) <= 2)) = 0 THEN list_concat(acc, p) ELSE acc END)) AS period FROM t),
v AS (SELECT u.user_id, c.frames, u.period, c.acf, a.frame_index AS i,
             cast(greatest(0.0::DOUBLE, 100 - abs(a.cents - b.cents) * 0.01::DOUBLE) AS FLOAT)::DOUBLE / 100 AS now,
             cast(greatest(0.0::DOUBLE, 100 - abs(a.cents - z.cents) * 0.01::DOUBLE) AS FLOAT)::DOUBLE / 100 AS seam
      FROM u JOIN c ON c.user_id = u.user_id AND c.period = u.period JOIN e a ON a.user_id = u.user_id
      JOIN e b ON b.user_id = u.user_id AND b.frame_index = a.frame_index + u.period
      JOIN e z ON z.user_id = u.user_id AND z.frame_index = a.frame_index + u.period - 1),
f AS (SELECT user_id, frames, period, acf, first(i ORDER BY seam DESC, i) AS start_frame, max(seam) AS smoothness FROM v
      WHERE now >= acf * 0.85::DOUBLE GROUP BY ALL HAVING count(*) >= period / 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY acf * smoothness DESC, acf DESC, period) AS rank FROM f)
SELECT user_id, rank, start_frame, period, cast(floor(acf * smoothness * 1e6::DOUBLE + 0.5) AS BIGINT) AS score_micro,
       cast(floor(smoothness * 1e6::DOUBLE + 0.5) AS BIGINT) AS smoothness_micro, cast(floor(period * 1e6::DOUBLE / frames + 0.5) AS BIGINT) AS coverage_micro
FROM o WHERE rank <= 6""")
def loop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loops.loop_candidates(user_frames(spark, sf_dir), U, "cents", 0.01)
    micro = lambda c: F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(f"{c}_micro")
    return found.select(*U, F.col("rank").cast("long").alias("rank"), "start_frame", "period", micro("score"), micro("smoothness"), micro("coverage"))


@registered("reorganize", f"""WITH {OR},
n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM o)
SELECT o_custkey, o_orderkey, n - 1 - frame_index AS frame_index FROM n
UNION ALL SELECT o_custkey, o_orderkey, n AS frame_index FROM n WHERE frame_index = 0""")
def reorganize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders backwards, and the first once more at the end."""
    seq = order_frames(spark, sf_dir).select("o_custkey", "o_orderkey", "frame_index")
    n = seq.withColumn("n", F.count("*").over(W.partitionBy("o_custkey")))
    order = n.select("o_custkey", (F.col("n") - 1 - F.col("frame_index")).alias("new_index"), F.col("frame_index").alias("old_index"))
    order = order.union(n.where("frame_index = 0").select("o_custkey", "n", "frame_index"))
    return documents.reorganize(seq, order, C)


@registered("merge_sequences", f"""WITH {OR},
m AS (SELECT c_custkey, c_nationkey, coalesce(sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift
      FROM (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey)
SELECT c_nationkey AS merged, o_orderkey, frame_index + shift AS frame_index FROM o JOIN m ON c_custkey = o_custkey""")
def merge_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's customers' sequences chained in order of customer."""
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("merged"), F.col("c_custkey").alias("position"))
    return documents.merge_sequences(order_frames(spark, sf_dir), members, "o_custkey").select("merged", "o_orderkey", "frame_index")


@registered("split_sequence", f"""WITH {OR} SELECT o_custkey, o_orderkey, frame_index // 4 AS part, frame_index % 4 AS frame_index FROM o""")
def split_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in parts of four."""
    seq = order_frames(spark, sf_dir).select("o_custkey", "o_orderkey", "frame_index")
    parts = seq.groupBy("o_custkey").agg(F.max("frame_index").alias("last")).select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 4))).alias("part"))
    return documents.split_sequence(seq, parts.select("o_custkey", "part", (F.col("part") * 4).alias("start"), (F.col("part") * 4 + 3).alias("end")), C)


@registered("delete_strip", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return documents.strip_owned(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@registered("upsert_override", """
WITH p AS (SELECT l_partkey AS k, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey)
SELECT coalesce(p_partkey, k) AS part_key, p_size AS size, coalesce(price, p_retailprice) AS price
FROM part FULL JOIN p ON k = p_partkey WHERE NOT (p_size IS NOT DISTINCT FROM 1)""")
def upsert_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices replaced by the highest returned one; parts of size 1 are the default row."""
    current = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    patch = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("part_key")).agg(F.max("l_extendedprice").alias("price"))
    return documents.upsert(current, patch, ["part_key"], {"size": 1})


@registered("revision_compare", """
WITH l AS (SELECT c_nationkey, c_mktsegment, sha256(concat_ws('|', count(*)::VARCHAR, max(c_custkey)::VARCHAR)) AS h FROM customer WHERE c_acctbal >= 5000 GROUP BY ALL),
r AS (SELECT c_nationkey, c_mktsegment, sha256(concat_ws('|', count(*)::VARCHAR, max(c_custkey)::VARCHAR)) AS h FROM customer WHERE c_acctbal < 6000 GROUP BY ALL)
SELECT coalesce(l.c_nationkey, r.c_nationkey) AS c_nationkey, coalesce(l.c_mktsegment, r.c_mktsegment) AS c_mktsegment,
       CASE WHEN l.h IS NULL THEN 'added' WHEN r.h IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM l FULL JOIN r ON l.c_nationkey = r.c_nationkey AND l.c_mktsegment = r.c_mktsegment WHERE l.h IS DISTINCT FROM r.h""")
def revision_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["c_nationkey", "c_mktsegment"]
    state = lambda where: table(spark, sf_dir, "customer").where(where).groupBy(*keys).agg(F.count("*").alias("n"), F.max("c_custkey").alias("m"))
    return documents.compare_revisions(state("c_acctbal >= 5000"), state("c_acctbal < 6000"), keys, ["n", "m"])


@registered("revision_retention", f"""WITH {OR},
r AS (SELECT o_custkey, o_orderkey, o_orderpriority <> '1-URGENT' AS automatic,
             row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS latest,
             row_number() OVER (PARTITION BY o_custkey, o_orderpriority <> '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM o)
SELECT o_custkey, o_orderkey FROM r WHERE automatic AND latest > 1 AND nth > 5""")
def revision_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return documents.prune_revisions(orders, C, newest, F.col("o_orderpriority") != "1-URGENT", 5).select("o_custkey", "o_orderkey")


@registered("validate_rules", """
WITH m AS (
  SELECT 'order without lines' AS message, o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
  UNION ALL SELECT 'customer without orders', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
  UNION ALL SELECT 'line with unknown part', l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
  UNION ALL SELECT 'negative balance', c_custkey FROM customer WHERE c_acctbal < 0)
SELECT message, key, CASE WHEN regexp_matches(message, 'order|line') THEN 'bind' WHEN regexp_matches(message, 'customer|unknown') THEN 'gameplay' ELSE 'standalone' END AS layer FROM m""")
def validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of anti-joins and row rules, classified by the first pattern that matches."""
    t = lambda n: table(spark, sf_dir, n)
    say = lambda df, message, key: df.select(F.lit(message).alias("message"), F.col(key).alias("key"))
    found = say(t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "order without lines", "o_orderkey")
    found = found.union(say(t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"), "customer without orders", "c_custkey"))
    found = found.union(say(t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left_anti"), "line with unknown part", "l_orderkey"))
    found = found.union(say(t("customer").where("c_acctbal < 0"), "negative balance", "c_custkey"))
    return found.withColumn("layer", documents.first_class(F.col("message"), [("order|line", "bind"), ("customer|unknown", "gameplay")], "standalone"))


@registered("playback_timeline", f"""WITH {OR},
d AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE cents END AS play FROM o)
SELECT o_custkey, frame_index, coalesce(sum(play) OVER w, 0)::DOUBLE AS starts_at, coalesce(sum(play) OVER w, 0)::DOUBLE + play * 0.5::DOUBLE AS arrives_at
FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def playback_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are disabled frames, urgent ones have a duration of their own; others last their price."""
    seq = order_frames(spark, sf_dir)
    override = seq.where("o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'").select("o_custkey", "frame_index", F.lit(2.0).alias("duration"), (F.col("o_orderstatus") == "F").alias("disabled"))
    timed = timeline.playback_durations(seq.withColumn("duration", F.col("cents").cast("double")), override, ["o_custkey", "frame_index"])
    return sequences.arrival(timed, C, F.col("play_duration")).select("o_custkey", "frame_index", "starts_at", "arrives_at")


@registered("gif_delays", """
SELECT l_orderkey, l_linenumber, l_partkey, greatest(1, cast(floor((l_discount + l_tax) * 100 + 0.5) AS BIGINT)) AS delay_cs FROM lineitem""")
def gif_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", timeline.delay_centiseconds(F.col("l_discount") + F.col("l_tax")).alias("delay_cs"))


@registered("keyframe_interpolate", f"""WITH {EV},
k AS (SELECT user_id, frame_index * 3 AS frame, cents::DOUBLE AS v, event_type, lead(frame_index * 3) OVER w AS nf, lead(cents::DOUBLE) OVER w AS nv FROM e WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
x AS (SELECT *, unnest(range(frame, coalesce(nf - 1, frame) + 1)) AS pos FROM k)
SELECT user_id, pos AS frame, event_type,
       v + coalesce(nv - v, 0.0) * CASE WHEN nf IS NULL THEN 0.0 ELSE (pos - frame)::DOUBLE / (nf - frame) END AS v FROM x""")
def keyframe_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values as keys three frames apart, linear in between; the event type changes at keys."""
    keys = user_frames(spark, sf_dir).select("user_id", (F.col("frame_index") * 3).alias("frame"), F.col("cents").cast("double").alias("v"), "event_type")
    return timeline.interpolate(keys, U, ["v"], steps=["event_type"])


@registered("asof_pose", f"""WITH {EV},
p AS (SELECT user_id, floor(epoch(ts))::DOUBLE AS arrival, max(cents)::DOUBLE AS v FROM e GROUP BY ALL),
t AS (SELECT DISTINCT user_id, arrival + 1800 AS time FROM p),
a AS (SELECT t.user_id, time, l.arrival AS la, l.v AS lv FROM t ASOF LEFT JOIN p l ON t.user_id = l.user_id AND t.time >= l.arrival),
b AS (SELECT a.*, r.arrival AS ra, r.v AS rv FROM a ASOF LEFT JOIN p r ON a.user_id = r.user_id AND a.time <= r.arrival),
c AS (SELECT user_id, time, coalesce(la, ra) AS la, coalesce(lv, rv) AS lv, coalesce(ra, la) AS ra, coalesce(rv, lv) AS rv FROM b)
SELECT user_id, time, lv + (rv - lv) * least(greatest((time - la) / greatest(1e-6, ra - la), 0.0), 1.0) AS v FROM c""")
def asof_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's value half an hour after each of their events, between the events around that time."""
    ev = user_frames(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").cast("long").cast("double").alias("arrival"), "cents")
    poses = ev.groupBy("user_id", "arrival").agg(F.max("cents").cast("double").alias("v"))
    return timeline.pose_at(poses, poses.select("user_id", (F.col("arrival") + 1800).alias("time")), U, ["v"])


@registered("dominant_bucket", """
WITH p AS (SELECT l_returnflag, cast(l_quantity * 5 AS BIGINT) AS r, l_suppkey % 256 AS g, l_linenumber * 30::BIGINT AS b, l_orderkey * 8 + l_linenumber AS seen FROM lineitem),
x AS (SELECT l_returnflag, r, g, b, count(*) AS n, min(seen) AS first_seen FROM p GROUP BY ALL),
y AS (SELECT *, sum(n) OVER k AS bucket_count, min(first_seen) OVER k AS bucket_seen, sum(r * n) OVER k AS sr, sum(g * n) OVER k AS sg, sum(b * n) OVER k AS sb
      FROM x WINDOW k AS (PARTITION BY l_returnflag, r >> 4, g >> 4, b >> 4)),
z AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY bucket_count DESC, bucket_seen, n DESC,
        (r * bucket_count - sr) ** 2 + (g * bucket_count - sg) ** 2 + (b * bucket_count - sb) ** 2, first_seen) AS q FROM y)
SELECT l_returnflag, r, g, b, n AS value_count, bucket_count::BIGINT AS bucket_count FROM z WHERE q = 1""")
def dominant_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_quantity") * 5).cast("long").alias("r"), (F.col("l_suppkey") % 256).alias("g"), (F.col("l_linenumber") * 30).cast("long").alias("b"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seen")
    )
    return documents.dominant_value(px, ["l_returnflag"], ["r", "g", "b"], F.col("seen"))


@registered("modal_size", """
WITH n AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY ALL)
SELECT p_brand, p_size, n, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first_seen) AS q FROM n) WHERE q = 1""")
def modal_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.modal_value(table(spark, sf_dir, "part"), ["p_brand"], ["p_size"], F.col("p_partkey"))


MASS = "m AS (SELECT l_returnflag, cast(l_quantity AS BIGINT) AS frame_index, count(*) AS mass FROM lineitem GROUP BY ALL)"


def quantity_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", F.col("l_quantity").cast("long").alias("frame_index")).agg(F.count("*").alias("mass"))


@registered("quantile_trim", f"""WITH {MASS},
r AS (SELECT *, sum(mass) OVER (PARTITION BY l_returnflag ORDER BY frame_index) AS up, sum(mass) OVER (PARTITION BY l_returnflag ORDER BY frame_index DESC) AS down,
             sum(mass) OVER (PARTITION BY l_returnflag) AS total FROM m)
SELECT l_returnflag, min(frame_index) FILTER (up > total * 0.08::DOUBLE) AS start_pos, max(frame_index) FILTER (down > total * 0.08::DOUBLE) AS end_pos FROM r GROUP BY l_returnflag""")
def quantile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.trimmed_span(quantity_mass(spark, sf_dir), ["l_returnflag"], "mass", 0.08)


DENSE = """
m AS (SELECT user_id, cast(floor(epoch(ts)) AS BIGINT) // 3600 AS frame_index, count(*) AS mass FROM events GROUP BY ALL),
s AS (SELECT *, sum(mass) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m),
d AS (SELECT *, max(near) OVER (PARTITION BY user_id) AS top FROM s),
k AS (SELECT * FROM d WHERE near >= greatest(4.0 * 1, top * 0.22::DOUBLE)),
g AS (SELECT *, coalesce((frame_index - lag(frame_index) OVER (PARTITION BY user_id ORDER BY frame_index) > 25)::INT, 0) AS fresh FROM k),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY frame_index) AS run FROM g),
x AS (SELECT user_id, run, min(frame_index) AS start_pos, max(frame_index) AS end_pos, sum(mass)::BIGINT AS run_mass FROM r GROUP BY ALL)"""


@registered("dense_span", f"""WITH {DENSE}
SELECT user_id, start_pos, end_pos, run_mass FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run_mass DESC, start_pos) AS q FROM x) WHERE q = 1""")
def dense_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's heaviest run of busy hours, over gaps of a day."""
    hours = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("ts").cast("timestamp").cast("long") / 3600).cast("long").alias("frame_index")).agg(F.count("*").alias("mass"))
    return sequences.dense_runs(hours, U, "mass", floor=0.8, share=0.22, gap=24)


@registered("even_sample", """
WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
k AS (SELECT *, least(n, 24) AS k FROM n)
SELECT DISTINCT user_id, n, CASE WHEN k > 1 THEN cast(floor(i * (n - 1)::DOUBLE / (k - 1) + 0.5) AS BIGINT) ELSE 0 END AS frame_index
FROM (SELECT *, unnest(range(0, k)) AS i FROM k)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.even_samples(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n", 24)


@registered("active_range", f"""WITH {EV}, p AS (SELECT *, max(cents) OVER (PARTITION BY user_id) AS peak FROM e)
SELECT user_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS active FROM p WHERE cents >= peak * 0.12::DOUBLE GROUP BY user_id""")
def active_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.active_range(user_frames(spark, sf_dir), U, "cents")


@registered("temporal_stability", f"""WITH {EV},
d AS (SELECT user_id, count(*) OVER g AS n, abs(cents * count(*) OVER g - sum(cents) OVER g) AS dc, abs(length(props) * count(*) OVER g - sum(length(props)) OVER g) AS da FROM e WINDOW g AS (PARTITION BY user_id))
SELECT user_id, count(*) AS frames, cast(floor((sum(dc)::BIGINT * 1000000)::DOUBLE / (count(*) * count(*))) AS BIGINT) AS centre_drift_micro,
       cast(floor((sum(da)::BIGINT * 1000000)::DOUBLE / (count(*) * count(*))) AS BIGINT) AS area_drift_micro FROM d GROUP BY user_id""")
def temporal_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.temporal_stability(user_frames(spark, sf_dir).withColumn("size", F.length("props").cast("long")), U, "cents", "size")


@registered("topk_subject", """
SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS q FROM customer) WHERE q = 1""")
def topk_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = documents.top_one(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])
    return best.select("c_nationkey", "c_custkey", "c_acctbal")


@registered("spatial_fuse", f"""WITH {EV},
g AS (SELECT user_id, event_id, event_type, frame_index * 20 AS x1, frame_index * 20 + 30 + cents % 50 AS x2, cents % 40 AS y1, cents % 40 + 60 AS y2 FROM e),
j AS (SELECT b.user_id, b.event_id AS box_id, p.event_id AS part_id, (b.event_type = 'click') = (p.event_type = 'view') AS fits,
             greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0) AS met, (b.x2 - b.x1) * (b.y2 - b.y1) AS own
      FROM g b JOIN g p ON b.user_id = p.user_id WHERE b.event_type IN ('click', 'purchase') AND p.event_type NOT IN ('click', 'purchase')),
k AS (SELECT *, met::DOUBLE / greatest(1, own) AS share, fits::INT AS affinity FROM j)
SELECT user_id, box_id, part_id, share, affinity FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, box_id ORDER BY affinity DESC, share DESC, part_id) AS q FROM k WHERE share >= 0.25) WHERE q = 1""")
def spatial_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases as labelled boxes, other events as parts, on a user's canvas."""
    x = F.col("frame_index") * 20
    y = F.col("cents") % 40
    g = user_frames(spark, sf_dir).select("user_id", "event_id", "event_type", x.alias("x1"), (x + 30 + F.col("cents") % 50).alias("x2"), y.alias("y1"), (y + 60).alias("y2"))
    side = lambda df, p, key: df.select("user_id", F.col("event_id").alias(key), F.col("event_type").alias(f"{p}kind"), *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")])
    boxes = side(g.where("event_type IN ('click', 'purchase')"), "b", "box_id")
    parts = side(g.where("event_type NOT IN ('click', 'purchase')"), "p", "part_id")
    fits = ((F.col("bkind") == "click") == (F.col("pkind") == "view")).cast("int")
    return spatial.best_overlaps(boxes, parts, U, fits).select("user_id", "box_id", "part_id", "share", "affinity")


RGB = "c AS (SELECT p_partkey, p_partkey % 256 AS r, p_size * 5 AS g, cast(p_retailprice AS BIGINT) % 256 AS b FROM part)"
LIN = "CASE WHEN {0} / 255 <= 0.04045::DOUBLE THEN {0} / 255 / 12.92::DOUBLE ELSE pow(({0} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def part_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_partkey") % 256).alias("r"), (F.col("p_size") * 5).alias("g"), (F.floor("p_retailprice").cast("long") % 256).alias("b"))


@registered("oklab", f"""WITH {RGB.replace('cast(p_retailprice AS BIGINT)', 'cast(floor(p_retailprice) AS BIGINT)')},
l AS (SELECT p_partkey, {LIN.format('r')} AS lr, {LIN.format('g')} AS lg, {LIN.format('b')} AS lb FROM c),
m AS (SELECT p_partkey, cbrt(lr * 0.4122214708::DOUBLE + lg * 0.5363325363::DOUBLE + lb * 0.0514459929::DOUBLE) AS x,
             cbrt(lr * 0.2119034982::DOUBLE + lg * 0.6806995451::DOUBLE + lb * 0.1073969566::DOUBLE) AS y,
             cbrt(lr * 0.0883024619::DOUBLE + lg * 0.2817188376::DOUBLE + lb * 0.6299787005::DOUBLE) AS z FROM l)
SELECT p_partkey, cast(floor((x * 0.2104542553::DOUBLE + y * 0.793617785::DOUBLE + z * -0.0040720468::DOUBLE) * 100000 + 0.5) AS BIGINT) AS lightness,
       cast(floor((x * 1.9779984951::DOUBLE + y * -2.428592205::DOUBLE + z * 0.4505937099::DOUBLE) * 100000 + 0.5) AS BIGINT) AS green_red,
       cast(floor((x * 0.0259040371::DOUBLE + y * 0.7827717662::DOUBLE + z * -0.808675766::DOUBLE) * 100000 + 0.5) AS BIGINT) AS blue_yellow FROM m""")
def oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = part_colours(spark, sf_dir).select("p_partkey", color.oklab(F.col("r"), F.col("g"), F.col("b")).alias("x"))
    q = lambda n: F.floor(F.col(f"x.{n}") * 100000 + 0.5).cast("long")
    return lab.select("p_partkey", q("l").alias("lightness"), q("a").alias("green_red"), q("b").alias("blue_yellow"))


@registered("color_distance", f"""WITH {RGB.replace('cast(p_retailprice AS BIGINT)', 'cast(floor(p_retailprice) AS BIGINT)')}
SELECT p_partkey, cast(floor(least(greatest(sqrt((2 + (r + 30) / 2 / 256) * (r - 30) * (r - 30) + 4 * (g - 180) * (g - 180) + (2 + (255 - (r + 30) / 2) / 256) * (b - 90) * (b - 90)) / 764.834::DOUBLE * 100, 0.0), 100.0) * 10000 + 0.5) AS BIGINT) AS distance
FROM c""")
def color_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = color.redmean_distance([F.col("r"), F.col("g"), F.col("b")], [F.lit(30), F.lit(180), F.lit(90)])
    return part_colours(spark, sf_dir).select("p_partkey", F.floor(d * 10000 + 0.5).cast("long").alias("distance"))


@registered("cell_grid", """
SELECT n_nationkey, chr((65 + c)::INT) || r AS cell, n_nationkey * 10 + c * 64.0::DOUBLE / 4 AS x1, n_nationkey * 10 + (c + 1) * 64.0::DOUBLE / 4 AS x2, (r - 1) * 48.0::DOUBLE / 3 AS y1, r * 48.0::DOUBLE / 3 AS y2
FROM nation, (SELECT unnest(range(0, 4)) AS c), (SELECT unnest(range(1, 4)) AS r)""")
def cell_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(64.0).alias("width"), F.lit(48.0).alias("height"))
    return spatial.cell_grid(views, 4, 3).select("n_nationkey", "cell", "x1", "x2", "y1", "y2")


@registered("natural_sort", """
WITH k AS (SELECT n_regionkey, n_nationkey, lower(n_name) || n_nationkey AS name FROM nation),
p AS (SELECT *, array_to_string(list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(ltrim(x, '0'), 20, '0') ELSE x END), '') AS key FROM k)
SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY key, name) - 1 AS place FROM p""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region by name and number; the window is over a region's nations."""
    named = table(spark, sf_dir, "nation").withColumn("name", F.concat(F.lower("n_name"), F.col("n_nationkey").cast("string")))
    place = F.row_number().over(W.partitionBy("n_regionkey").orderBy(text.natural_key(F.col("name")), "name")) - 1
    return named.select("n_regionkey", "n_nationkey", place.cast("long").alias("place"))
