"""Verdicts, contact sheets, sampling, keys, geometry and settings on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from strandwork.functions import medians, text
from strandwork.operators import documents, rasters, sequences, sheets, spatial, timeline

PX = "image string, x long, y long, r int, g int, b int, a int"


def image(name, colour, side=20):
    return [(name, x, y, *colour(x, y)) for x in range(side) for y in range(side)]


def test_cut_verdicts(spark):
    """Transparent border; a plate; a plate whose inside is gone; a figure over most of the band; stray plate and an open rim."""
    inner = lambda x, y: 3 <= x < 17 and 3 <= y < 17
    figure, plate, clear = (200, 40, 40, 255), (90, 90, 90, 255), (0, 0, 0, 0)
    made = {
        "cut": (lambda x, y: figure if inner(x, y) else clear, True), "plate": (lambda x, y: figure if inner(x, y) else plate, False),
        "punched": (lambda x, y: clear if inner(x, y) else plate, True), "full": (lambda x, y: figure, False),
        "stray": (lambda x, y: plate if (x, y) == (1, 1) else clear if x in (0, 19) or y in (0, 19) else figure, False),
        "open": (lambda x, y: clear if x in (0, 19) or y in (0, 19) else figure, True),
    }
    px = spark.createDataFrame([r for n, (f, _) in made.items() for r in image(n, f)], PX)
    neutral = F.greatest("r", "g", "b") - F.least("r", "g", "b") <= 24
    got = {r.image: r.cut for r in rasters.cut_out(px, ["image"], 20, 20, neutral).collect()}
    assert got == {n: want for n, (_, want) in made.items()}


def test_measurements_of_a_clear_image(spark):
    px = spark.createDataFrame(image("none", lambda x, y: (0, 0, 0, 16), 3) + [("dot", 1, 2, 255, 255, 255, 255)], PX)
    rows = {r.image: r for r in rasters.frame_measurements(px, ["image"]).collect()}
    assert (rows["none"].body_height, rows["none"].opaque, rows["none"].sole_x_milli) == (0, 0, None)
    assert (rows["dot"].body_width, rows["dot"].feet_y, rows["dot"].near_white, rows["dot"].sole_x_milli) == (1, 2, 1, 1000)


def test_contact_sheet(spark):
    frames = spark.createDataFrame([("s", i) for i in range(5)] + [("t", 0)], "clip string, frame_index long")
    got = {(r.clip, r.frame_index): (r.column, r.row, r.x, r.y, r.sheet_width, r.sheet_height) for r in sheets.contact_cells(frames, ["clip"], 3, 8, 2).collect()}
    assert got["s", 4] == (1, 1, 12, 12, 32, 22) and got["t", 0] == (0, 0, 2, 2, 12, 12)
    px = spark.createDataFrame([("t", 0, x, 0, 9, 8, 7, 255 if x else 0) for x in range(2)], "clip string, frame_index long, x int, y int, r int, g int, b int, a int")
    placed = sheets.contact_cells(frames.where("clip = 't'"), ["clip"], 3, 8, 2)
    shown = {(r.sheet_x, r.sheet_y): r.r for r in sheets.contact_pixels(px, placed, ["clip"], 2, 1, 8).collect()}
    assert len(shown) == 64 and shown[2, 2] == 200 and shown[2, 6] == 150 and {shown[x, y] for x in range(6, 10) for y in range(2, 10)} == {9}


@pytest.mark.parametrize(("low", "high", "count", "want"), [(0, 9, 1, [5]), (2, 2, 3, [2, 2, 2]), (0, 9, 4, [0, 3, 6, 9]), (5, 6, 4, [5, 5, 6, 6]), (3, 1, 2, []), (0, 5, 0, [])])
def test_spread_places(spark, low, high, count, want):
    assert spark.range(1).select(sequences.spread_places(F.lit(low), F.lit(high), F.lit(count)).alias("p")).first().p == want


def test_spread_places_are_distinct_where_there_is_room(spark):
    sizes = spark.createDataFrame([(n, k) for n in range(1, 30) for k in range(1, n + 1)], "n long, k long")
    rows = sizes.select("n", "k", sequences.spread_places(F.lit(0), F.col("n") - 1, F.col("k")).alias("p")).collect()
    assert all(len(set(r.p)) == r.k and r.p == sorted(r.p) for r in rows)


def test_keys_and_merges(spark):
    keys = spark.createDataFrame([("a/b",), ("a/b:7",), ("a/b:x",), ("a/bc:7",), (None,)], "k string")
    got = [r.n for r in keys.select(documents.rewritten_key(F.col("k"), F.lit("a/b"), F.lit("z"), 3).alias("n")).collect()]
    assert got == ["z", "z:10", "z:x", "a/bc:7", None]
    members = spark.createDataFrame([("m", 0, "feet", None), ("m", 1, "feet", True), ("n", 0, "feet", None), ("n", 1, "feet", None), ("o", 0, "feet", True), ("o", 1, "head", True)], "merged string, position long, anchor string, flip boolean")
    assert {r.merged: r.problem for r in documents.merge_problems(members, ["anchor", "flip"]).collect()} == {"m": "different flip", "n": None, "o": "different anchor"}
    assert {r.problem for r in documents.merge_problems(members, ["anchor"], 1).collect()} == {"too many members"}
    none = spark.createDataFrame([], "old string, new string")
    assert documents.renamed(keys.withColumn("o", F.lit("a/b")), none, "o", ["k"]).count() == 5


def test_played_and_summary(spark):
    seq = spark.createDataFrame([("a", i, v) for i, v in enumerate((12, 20, 28, 30, None))], "g string, frame_index long, v long")
    overrides = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("a", 2, False), ("a", 9, True)], "g string, frame_index long, disabled boolean")
    kept, counts = timeline.played(seq, overrides, ["g", "frame_index"], ["g"])
    assert sorted((r.frame_index, r.new_index) for r in kept.collect()) == [(0, 0), (2, 1), (3, 2), (4, 3)]
    assert [(r.kept, r.skipped) for r in counts.collect()] == [(4, 1)]
    row = medians.summary(seq, ["g"], "v").first()
    assert (row.n, row.least, row.most, row.middle, row.total) == (4, 12, 30, 24.0, 90)


def test_settings(spark):
    rows = spark.createDataFrame([("4,5",), ("[1, -2.5, 9]",), ('{"x": 1}',), ('{"space": "view", "x": 1, "y": 2}',), (None,), ("x",)], "t string")
    assert [r.p and (r.p.x, r.p.y) for r in rows.select(text.parse_point(F.col("t")).alias("p")).collect()] == [(4, 5), (1, -2.5), None, None, None, None]
    rows = spark.createDataFrame([("8x6",), ("8 × 6",), ("7",), ("1x9",), ("65",), ("",), (None,)], "t string")
    assert [r.d and (r.d.x, r.d.y) for r in rows.select(text.parse_divisions(F.col("t")).alias("d")).collect()] == [(8, 6), (8, 6), (7, 7), None, None, None, None]
    rows = spark.createDataFrame([('{"b": {"d": 1, "c": [{"z": 1, "a": 2}]}, "a": "x"}',), ("{broken",), (None,)], "t string")
    assert [r.c for r in rows.select(documents.canonical_json(F.col("t")).alias("c")).collect()] == ['{"a":"x","b":{"c":[{"a":2,"z":1}],"d":1}}', None, None]


def test_geometry(spark):
    views = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 20.0, 4, 2, ["a1", "B2", "E1", "A3", "1A"])], "v long, x double, y double, width double, height double, columns int, rows int, names array<string>")
    row = spatial.cell_union(spatial.named_cells(views, "names"), ["v"]).first()
    assert (row.x1, row.y1, row.x2, row.y2, row.mid_x, row.mid_y) == (0, 0, 20, 20, 10, 10)
    box = [F.lit(v) for v in (-1.5, 2.2, 3.1, 2.9)]
    one = spark.range(1).select(spatial.integer_crop(box).alias("c"), spatial.transformed_bounds([F.lit(float(v)) for v in (0, 0, 2, 1)], (F.lit(1.0), F.lit(1.0)), F.lit(180.0), (F.lit(5.0), F.lit(0.0))).alias("b")).first()
    assert tuple(one.c) == (-2, 2, 6, 1) and [round(v, 9) + 0 for v in one.b] == [3, -1, 5, 0]
    ticks = spatial.grid_ticks(spark.createDataFrame([(-3.0, 4.0), (1.0, 1.5)], "low double, high double"), "low", "high", F.lit(2))
    assert sorted(r.tick for r in ticks.collect()) == [-2, 0, 2, 4]
