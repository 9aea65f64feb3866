"""Registered queries: sequences analysed in one pass, exclusive grounding, frames of sheets, a store of revisions, JSON
documents and script texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.operators import analysis, revisions, sheets, spatial
from strandwork.plans.catalog import CLOSE, EV, U, registered, user_frames
from strandwork.plans.rasters import PX, pixels
from strandwork.session import table
from strandwork.sources import documents

NEAR = "greatest(0.0, 100 - abs({} - {}) * 0.01::DOUBLE)"


@registered("sequence_analysis", f"""WITH RECURSIVE {EV},
n AS (SELECT user_id, count(*) AS frames, min(cents) AS least, max(cents) AS most, list_sort(list(cents))[count(*) // 2 + 1] AS middle FROM e GROUP BY user_id),
w AS (SELECT *, lag(cents) OVER o AS b, lead(cents) OVER o AS a, first_value(cents) OVER o AS c0 FROM e WINDOW o AS (PARTITION BY user_id ORDER BY frame_index)),
s AS (SELECT *, {NEAR.format("b", "a")} - least({NEAR.format("b", "cents")}, {NEAR.format("cents", "a")}) AS score, abs(cents - c0) <= greatest(1.0, greatest(abs(cents), abs(c0)) * 0.08::DOUBLE) AS rest FROM w),
t AS (
  SELECT user_id, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND score > 0 AND score >= 12) AS jumps, min(frame_index) FILTER (NOT rest) AS moved, max(frame_index) FILTER (NOT rest) AS last_moved,
         max(frame_index) AS last_frame, arg_max(rest, frame_index) AS back, sum(coalesce(abs(cents - b), 0))::BIGINT AS activity FROM s GROUP BY user_id),
f(user_id, i, anchor, anchor_cents, cents, held) AS (
  SELECT user_id, 0::BIGINT, 0::BIGINT, cents, cents, false FROM e WHERE frame_index = 0
  UNION ALL
  SELECT f.user_id, f.i + 1, CASE WHEN x.held THEN f.anchor ELSE f.i + 1 END, CASE WHEN x.held THEN f.anchor_cents ELSE x.cents END, x.cents, x.held
  FROM f JOIN LATERAL (SELECT e.cents, {NEAR.format("f.cents", "e.cents")} >= 88 AND {NEAR.format("f.anchor_cents", "e.cents")} >= 88 AS held FROM e WHERE e.user_id = f.user_id AND e.frame_index = f.i + 1) x ON true),
h AS (SELECT user_id, string_agg(i || ':' || anchor, ',' ORDER BY i) AS holds FROM f JOIN n USING (user_id) WHERE held AND frames >= 3 GROUP BY user_id)
SELECT n.user_id, frames, coalesce(holds, '') AS holds, jumps, coalesce(moved, 0) AS start_frame, CASE WHEN moved IS NULL OR NOT back THEN last_frame ELSE last_moved END AS end_frame, activity, least, most, middle
FROM n JOIN t USING (user_id) LEFT JOIN h ON h.user_id = n.user_id""")
def sequence_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.analyse(user_frames(spark, sf_dir), U, "cents", 88.0, CLOSE)
    text = F.array_join(F.transform("holds", lambda h: F.concat(h["frame_index"].cast("string"), F.lit(":"), h["match_index"].cast("string"))), ",")
    return out.withColumn("holds", text).withColumn("jumps", F.size("jumps").cast("long")).withColumn("frames", F.col("frames").cast("long"))


@registered("exclusive_fuse", f"""WITH RECURSIVE {EV},
g AS (SELECT user_id, event_id, event_type, frame_index * 20 AS x1, frame_index * 20 + 30 + cents % 50 AS x2, cents % 40 AS y1, cents % 40 + 60 AS y2 FROM e),
j AS (SELECT b.user_id, b.event_id AS box_id, p.event_id AS part_id, b.event_type = 'click' AS hand, p.event_type = 'view' AS contact, (b.event_id + p.event_id) % 3 AS affinity,
             greatest(least(b.x2, p.x2) - greatest(b.x1, p.x1), 0) * greatest(least(b.y2, p.y2) - greatest(b.y1, p.y1), 0) AS met, (b.x2 - b.x1) * (b.y2 - b.y1) AS own, (p.x2 - p.x1) * (p.y2 - p.y1) AS other
      FROM g b JOIN g p ON b.user_id = p.user_id WHERE b.event_type IN ('click', 'purchase') AND p.event_type NOT IN ('click', 'purchase')),
k AS (SELECT user_id, box_id, part_id, affinity, met::DOUBLE / greatest(1, own) AS share FROM j WHERE hand = contact AND met::DOUBLE / greatest(1, own) >= 0.25 AND (NOT hand OR met::DOUBLE / greatest(1, own + other - met) >= 0.2::DOUBLE)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY affinity DESC, share DESC, box_id, part_id) AS r FROM k),
fold AS (
  SELECT user_id, 0::BIGINT AS r, []::BIGINT[] AS boxes, []::BIGINT[] AS parts FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL
  SELECT f.user_id, f.r + 1, CASE WHEN list_contains(boxes, box_id) OR list_contains(parts, part_id) THEN boxes ELSE list_append(boxes, box_id) END,
         CASE WHEN list_contains(boxes, box_id) OR list_contains(parts, part_id) THEN parts ELSE list_append(parts, part_id) END
  FROM fold f JOIN r ON r.user_id = f.user_id AND r.r = f.r + 1),
z AS (SELECT user_id, unnest(boxes) AS box_id, unnest(parts) AS part_id FROM (SELECT user_id, arg_max(boxes, r) AS boxes, arg_max(parts, r) AS parts FROM fold GROUP BY user_id))
SELECT user_id, box_id, part_id, share, affinity FROM z JOIN k USING (user_id, box_id, part_id)""")
def exclusive_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as hands, views as points of contact, purchases as other labels and the remaining events as other parts."""
    x, y = F.col("frame_index") * 20, F.col("cents") % 40
    g = user_frames(spark, sf_dir).select("user_id", "event_id", "event_type", x.alias("x1"), (x + 30 + F.col("cents") % 50).alias("x2"), y.alias("y1"), (y + 60).alias("y2"))
    side = lambda df, p, key: df.select("user_id", F.col("event_id").alias(key), F.col("event_type").alias(f"{p}kind"), *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")])
    boxes, parts = side(g.where("event_type IN ('click', 'purchase')"), "b", "box_id"), side(g.where("event_type NOT IN ('click', 'purchase')"), "p", "part_id")
    affinity = (F.col("box_id") + F.col("part_id")) % 3
    return spatial.exclusive_overlaps(boxes, parts, U, affinity, F.col("bkind") == "click", F.col("pkind") == "view").select("user_id", "box_id", "part_id", "share", "affinity")


@registered("sheet_frames", f"""WITH {PX},
c AS (SELECT image_id, y // 3 * (3 + image_id % 2) + x // (2 + (image_id + 1) % 2) AS cell, x % (2 + (image_id + 1) % 2) AS fx, y % 3 AS fy, x // (2 + (image_id + 1) % 2) AS col, y // 3 AS row, r, g, b, a, 1 + (image_id + 1) % 2 AS w FROM px),
i AS (SELECT * FROM c WHERE fx < w AND fy < 2 AND col < 3 + image_id % 2 AND row < 3),
n AS (SELECT image_id, cell, row_number() OVER (PARTITION BY image_id ORDER BY cell) - 1 AS frame_index FROM i GROUP BY image_id, cell HAVING bool_or(a <> 0))
SELECT image_id, frame_index, fx AS x, fy AS y, r, g, b, a FROM i JOIN n USING (image_id, cell)""")
def sheet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image as a sheet of three columns of two pixels, or four of one, in three rows."""
    px = pixels(spark, sf_dir)
    odd = F.col("image_id") % 2
    size = lambda v: F.lit(v).cast("long")
    packings = px.select("image_id").distinct().select("image_id", (odd + 3).alias("columns"), size(3).alias("rows"), (2 - odd).alias("cell_w"), size(2).alias("cell_h"), size(1).alias("pad"))
    return sheets.sheet_frames(px, packings, "image_id")[0]


FILES = """now AS (SELECT o_custkey AS project, o_orderkey AS key, o_orderpriority || o_orderkey % 7 AS content, o_orderkey % 5 = 0 AS external FROM orders WHERE o_orderkey % 9 > 0),
was AS (SELECT o_custkey AS project, o_orderkey AS key, o_orderpriority || o_orderkey % 6 AS content, o_orderkey % 5 = 0 AS external FROM orders WHERE o_orderkey % 8 > 0)"""


def _saved(spark: SparkSession, sf_dir: str):
    """The store with each customer's earlier files as a revision, and the files of now."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    files = lambda m, skip: o.where(k % skip > 0).select(F.col("o_custkey").alias("project"), k.alias("key"), F.concat("o_orderpriority", (k % m).cast("string")).alias("content"), (k % 5 == 0).alias("external"))
    now, was = files(7, 9), files(6, 8)
    return revisions.save(revisions.empty(was), was, "first"), now


@registered("revision_new_content", f"""WITH {FILES}
SELECT DISTINCT project, sha256(content) AS hash, length(content)::BIGINT AS size FROM now n WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.project = n.project AND w.content = n.content)""")
def revision_new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, now = _saved(spark, sf_dir)
    return revisions.new_content(store, now).select("project", "hash", "size")


@registered("revision_restored", f"""WITH {FILES}, p AS (SELECT DISTINCT project FROM was WHERE project % 3 > 0)
SELECT * FROM now WHERE external OR project NOT IN (SELECT project FROM p)
UNION ALL SELECT * FROM was WHERE NOT external AND project IN (SELECT project FROM p)""")
def revision_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two customers of three go back to their first revision."""
    store, now = _saved(spark, sf_dir)
    chosen = store.revisions.where("project % 3 > 0").select("project", "revision_id")
    return revisions.restore(store, now, chosen, "safety")[1]


@registered("revision_undone", f"""WITH {FILES} SELECT * FROM now""")
def revision_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restore of all customers, taken back: the files are those of before."""
    store, now = _saved(spark, sf_dir)
    store, after = revisions.restore(store, now, store.revisions.select("project", "revision_id"), "safety")
    return revisions.undo(store, after, "again")[1]


@registered("revision_unreferenced", f"""WITH {FILES}
SELECT DISTINCT project, sha256(content) AS hash FROM was w WHERE NOT EXISTS (SELECT 1 FROM now n WHERE w.project = n.project AND w.content = n.content)""")
def revision_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only the first revision holds: content that goes when it is forgotten and the files of now are kept."""
    store, now = _saved(spark, sf_dir)
    store = revisions.save(store, now, "second")
    without = revisions.Store(store.contents, store.entries.where("revision_id <> 'first'"), store.revisions)
    return revisions.unreferenced(without).select("project", "hash")


@registered("json_documents", """WITH t AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN props[1:length(props) - 1 - event_id % 3] WHEN event_id % 5 = 0 THEN chr(65279) || props ELSE props END AS text FROM events)
SELECT event_id, CASE WHEN text IS NULL THEN 'missing' WHEN event_id % 7 = 0 THEN 'corrupt' ELSE 'good' END AS state,
       CASE WHEN text IS NULL THEN -1 WHEN event_id % 7 = 0 THEN NULL ELSE json_extract(replace(text, chr(65279), ''), '$.k')::BIGINT END AS k FROM t""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as documents: every eleventh is missing, every seventh is cut off, every fifth has a byte order mark."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    cut = F.substr(F.col("props"), F.lit(1), (F.length("props") - 1 - i % 3).cast("int"))
    text = F.when(i % 11 == 0, None).when(i % 7 == 0, cut).when(i % 5 == 0, F.concat(F.lit("﻿"), "props")).otherwise(F.col("props"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    return documents.parsed_documents(e.select("event_id", text.alias("text")), "text", schema, {"k": -1}).select("event_id", "state", "k")


@registered("script_heights", """WITH p AS (
  SELECT page_id, length(html) AS n, html FROM pages WHERE url NOT LIKE '%/fr/%'),
t AS (SELECT page_id, n, page_id % 3 > 0 AS shaped FROM p)
SELECT page_id, 'span' AS kind, abs(n % 500 - page_id % 90)::DOUBLE AS height FROM t WHERE abs(n % 500 - page_id % 90) BETWEEN 24 AND 420
UNION ALL SELECT page_id, 'height', (n % 600)::DOUBLE FROM t WHERE shaped AND n % 600 BETWEEN 24 AND 420
UNION ALL SELECT page_id, 'size', n % 100 + 0.5::DOUBLE FROM t WHERE shaped AND n % 100 + 0.5 BETWEEN 24 AND 420""")
def script_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as scripts that state numbers of theirs, those in one folder left out."""
    p, n, i = table(spark, sf_dir, "pages"), F.length("html"), F.col("page_id")
    number = lambda c: c.cast("string")
    lines = F.concat(
        F.col("html"), F.lit("\nvar a = PackedVector2Array([Vector2(0, "), number(n % 500), F.lit("), Vector2( 3.5 , "), number(i % 90), F.lit(")])\n"),
        F.when(i % 3 > 0, "var s = CapsuleShape2D.new()\n").otherwise(""), F.lit("s.height = "), number(n % 600), F.lit("\nr.size = Vector2(4, "), number(n % 100), F.lit(".5)\n"),
    )
    scripts = p.where(documents.outside(F.col("url"), ["fr"])).select("page_id", lines.alias("text"))
    return documents.script_heights(scripts, ["page_id"])
