"""Planting, registering, trimming and padding of frames on small hand-made tables, and scaled pixels against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandwork.operators import canvases

GEO = "clip string, frame_index long, width long, height long, min_x long, min_y long, max_x long, max_y long, opaque long, feet_y long, cx double, fx double, body_height long"
KEY = ["clip", "frame_index"]


def frame(clip, i, size=(8, 8), box=(2, 1, 5, 6), feet=6, **other):
    x1, y1, x2, y2 = box
    row = dict(clip=clip, frame_index=i, width=size[0], height=size[1], min_x=x1, min_y=y1, max_x=x2, max_y=y2, opaque=9, feet_y=feet, cx=(x1 + x2) / 2, fx=(x1 + x2) / 2, body_height=feet - y1 + 1)
    return tuple((row | other).values())


def test_planted_feet(spark):
    """Feet above the edge; feet with glow that touches the edge; with glow above it; nothing visible; a fraction as target."""
    rows = [frame("a", 0), frame("a", 1, box=(2, 1, 5, 7), feet=5), frame("a", 2, box=(2, 1, 5, 6), feet=4), frame("a", 3, box=(0, 0, 0, 0), feet=0, opaque=0)]
    got = {r.frame_index: (r.dx, r.dy, r.out_width, r.out_height) for r in canvases.plant_plan(spark.createDataFrame(rows, GEO)).collect()}
    assert got == {0: (0, 1, 8, 8), 1: (0, 0, 8, 8), 2: (0, 3, 8, 10), 3: (0, 7, 8, 8)}
    half = canvases.plant_plan(spark.createDataFrame(rows[:1], GEO), F.lit(-3.5)).first()
    assert half.dy == -1  # towards zero
    assert canvases.plant_plan(spark.createDataFrame([], GEO)).count() == 0


def test_registered_by_the_pivot(spark):
    """Each frame's own scale or the pivot's; a pivot beyond the end is the last frame; feet or boxes as measure."""
    rows = [frame("a", 0), frame("a", 1, box=(1, 3, 4, 6), feet=6, fx=3.25), frame("b", 0, box=(0, 0, 0, 0), feet=0, body_height=0)]
    g = spark.createDataFrame(rows, GEO)
    plan = lambda **more: {(r.clip, r.frame_index): r for r in canvases.register_plan(g, ["clip"], F.lit(9), **more).collect()}
    own, shared, feet = plan(), plan(pivot=5, equalize=False), plan(pivot=1, by_feet=True, boxes=True)
    assert (own["a", 0].scale, own["a", 1].scale, own["a", 1].dest_x, own["a", 1].dest_y) == (1.5, 2.25, 3.5, 6.0)
    assert (shared["a", 0].scale, shared["a", 0].dest_x, shared["b", 0].scale) == (2.25, 2.5, 9.0)
    assert (feet["a", 0].dest_x, feet["a", 0].source_x) == (3.25, 3.5)
    assert set(own["a", 0].asDict()) == set(g.columns) | {"scale", "source_x", "source_y", "dest_x", "dest_y"}


@pytest.mark.parametrize("seed", range(4))
def test_scaled_pixels(spark, seed):
    """Against a loop over new places; scales of 0 leave a frame, pixels off the canvas and clear ones go."""
    rng = random.Random(seed)
    plans, px, want = [], [], set()
    for i in range(12):
        w, h = rng.randint(1, 9), rng.randint(1, 9)
        scale = rng.choice([0.0, 0.3333, 0.5, 1.0, 1.5, 2.0, 3.7])
        sx, sy, dx, dy = (rng.randint(-4, 18) / 2 for _ in range(4))
        plans.append(("a", i, w, h, scale, sx, sy, dx, dy))
        old = {(x, y): rng.choice([0, 16, 17, 255]) for x in range(w) for y in range(h)}
        px += [("a", i, x, y, x * 16 + y, a) for (x, y), a in old.items()]
        for x in range(w):
            for y in range(h):
                at = (x, y) if scale <= 0 else (math.floor(sx + (x - dx) / scale + 0.5), math.floor(sy + (y - dy) / scale + 0.5))
                if old.get(at, 0) > 16:
                    want.add((i, x, y, at[0] * 16 + at[1]))
    plan = spark.createDataFrame(plans, "clip string, frame_index long, width long, height long, scale double, source_x double, source_y double, dest_x double, dest_y double")
    rows = canvases.scaled(spark.createDataFrame(px, "clip string, frame_index long, x int, y int, ink int, a int"), plan, KEY).collect()
    assert len(rows) == len(want) and {(r.frame_index, r.x, r.y, r.ink) for r in rows} == want


def test_trimmed(spark):
    """Anchors kept or not, in the middle and on the left; clear frames don't count, and a clip of them has no plan."""
    rows = [frame("a", 0), frame("a", 1, size=(12, 10), box=(0, 4, 6, 9), feet=9), frame("a", 2, box=(0, 0, 0, 0), opaque=0), frame("none", 0, opaque=0)]
    g = spark.createDataFrame(rows, GEO)
    trim = lambda left, keep: {(r.clip, r.frame_index): r for r in canvases.trim_plan(g, ["clip"], F.lit(left), keep, 1).collect()}
    show = lambda r: (r.out_width, r.out_height, r.dx, r.dy, r.exact, r.shift_x, r.shift_y, r.fits)
    # middles at 4 and 6: boxes from -2 and -6 to 2 and 1, from -7 and -6 to -1 and 0
    assert show(trim(False, True)["a", 0]) == (14, 8, 3, 0, True, 0.0, 0.0, True)
    assert show(trim(False, False)["a", 1]) == (10, 9, 1, -2, True, 2.0, -1.0, True)
    assert show(trim(True, True)["a", 0]) == (8, 8, 0, 0, True, 0.0, 0.0, True)
    assert trim(False, True)["a", 2].out_width == 14 and trim(False, True)["none", 0].out_width is None


def test_padded(spark):
    """An odd step about a middle is not exact; pixels off the canvas are counted if they have any alpha; sides have bounds."""
    g = spark.createDataFrame([frame("a", 0), frame("a", 1, size=(5, 4))], GEO)
    plan = canvases.pad_plan(g, F.lit(6), F.lit(5), F.lit(False))
    got = {r.frame_index: (r.dx, r.dy, r.exact, r.shift_x, r.fits) for r in plan.collect()}
    assert got == {0: (-1, -3, True, 0.0, True), 1: (1, 1, False, 0.5, True)}
    px = spark.createDataFrame([("a", 0, x, y, 1 if x < 4 else 0) for x in range(8) for y in range(8)] + [("a", 1, 0, 0, 255)], "clip string, frame_index long, x int, y int, a int")
    assert {r.frame_index: r.clipped for r in canvases.clipped(px, plan, KEY).collect()} == {0: 3 * 4 + 5, 1: 0}
    kept = canvases.moved(px, plan, KEY)
    assert kept.columns == ["clip", "frame_index", "a", "x", "y"] and kept.where("frame_index = 0").count() == 6 * 5
    assert not canvases.pad_plan(g, F.lit(4097), F.lit(5), F.lit(True)).first().fits


def test_geometry(spark):
    """A sole above glow; no sole known; nothing visible."""
    px = [("s", 0, x, y, 255 if y < 3 else 40) for x in range(1, 4) for y in range(1, 5)] + [("s", 1, 2, 2, 200), ("s", 2, 0, 0, 3)]
    px = spark.createDataFrame(px, "clip string, frame_index long, x int, y int, a int")
    rows = {r.frame_index: r for r in canvases.geometry(px, spark.createDataFrame([("s", 0, 2)], "clip string, frame_index long, sole_y int"), KEY).collect()}
    assert (rows[0].feet_y, rows[0].max_y, rows[0].body_height, rows[0].fx, rows[0].opaque) == (2, 4, 2, 2.0, 12)
    assert (rows[1].feet_y, rows[1].cx, rows[1].body_height) == (2, 2.0, 1)
    assert (rows[2].feet_y, rows[2].cx, rows[2].opaque, rows[2].body_height) == (0, 0.0, 0, 0)
