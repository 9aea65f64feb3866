"""Regions, holes, thickness and frames of sheets against plain walks over small images."""

import random

import pytest

from strandwork.functions.graph import components
from strandwork.operators import regions, sheets

SCHEMA = "image string, x long, y long, r int, g int, b int, a int"


def pixels(name, rows):
    """An image from lines of text: a blank is clear."""
    return [(name, x, y, 50, 100, 200, 0 if c == " " else 255) for y, line in enumerate(rows) for x, c in enumerate(line)]


def walk(rows, seen, corners):
    """Regions as sets of places, in reading order of their first."""
    left = {(y, x) for y, line in enumerate(rows) for x, c in enumerate(line) if (c != " ") == seen}
    out = []
    for at in sorted(left):
        if at not in left:
            continue
        region, todo = set(), [at]
        left.discard(at)
        while todo:
            y, x = todo.pop()
            region.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (corners or not (dx and dy)) and (y + dy, x + dx) in left:
                        left.discard((y + dy, x + dx))
                        todo.append((y + dy, x + dx))
        out.append(region)
    return out


def images():
    rng = random.Random(3)
    spiral = ["##########", "#        #", "# ###### #", "# #    # #", "# # ## # #", "# # #  # #", "# # #### #", "# #      #", "# ########", "#         "]
    made = {"spiral": spiral, "ring": ["####", "#  #", "# ##", "####"], "corner": ["#  ", " # ", "  #"], "none": ["   "] * 3, "full": ["###"] * 2}
    return made | {f"r{k}": ["".join(rng.choice("##  ") for _ in range(w)) for _ in range(9)] for k, w in enumerate((5, 70, 150))}


def test_parts_and_holes(spark):
    """Wide images, so that runs meet in several strips."""
    for name, rows in images().items():
        px = spark.createDataFrame(pixels(name, rows), SCHEMA)
        w, h = len(rows[0]), len(rows)
        got = [(r.part_id, r["count"], r.min_x, r.min_y, r.max_x, r.max_y, r.noise) for r in regions.part_statistics(px, ["image"], w, h).orderBy("part_id").collect()]
        want = [(k, len(p), min(x for _, x in p), min(y for y, _ in p), max(x for _, x in p), max(y for y, _ in p), len(p) < 4) for k, p in enumerate(walk(rows, True, True))]
        assert got == want, name
        inner = [p for p in walk(rows, False, False) if not any(y in (0, h - 1) or x in (0, w - 1) for y, x in p)]
        row = regions.holes(px, ["image"], w, h).first()
        assert (row.holes, row.hole_pixels) == (len(inner), sum(map(len, inner))), name


def test_statistics_of_a_part(spark):
    px = spark.createDataFrame([("i", x, y, 10, 20, 30, 100 if x < 4 else 200) for x in range(8) for y in range(2)], SCHEMA)
    r = regions.part_statistics(px, ["image"], 8, 4).first()
    assert (r.alpha, r.centre_x_milli, r.centre_y_milli, r.fill_milli, r.aspect_milli) == (2400, 4167, 500, 1000, 4000)
    assert (r.luma_milli, r.chroma_milli, r.border_milli) == (18596, 20000, 625)


@pytest.mark.parametrize("n", [1, 2, 300])
def test_components_of_paths_and_stars(spark, n):
    """A path whose names fall and rise, and a star; repeated and reversed edges and loops are harmless."""
    rng = random.Random(n)
    names = list(range(n + 1))
    rng.shuffle(names)
    path = [(names[i], names[i + 1]) for i in range(n)]
    star = [(10_000 + n, 10_000 + i) for i in range(n)]
    edges = spark.createDataFrame(path + star + path[:3] + [(b, a) for a, b in path[:5]] + [(77_777, 77_777)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in names} | {10_000 + i: 10_000 for i in range(n + 1)} | {77_777: 77_777}


def test_thickness(spark):
    """A straight blade with a guard: 24 bins from end to end, the guard's the widest; too few pixels give none."""
    blade = [(x, 5) for x in range(48)] + [(10, y) for y in range(2, 9)]
    px = spark.createDataFrame([("b", x, y, 0, 0, 0, 255) for x, y in sorted(set(blade))] + [("few", 0, 0, 0, 0, 0, 255)], SCHEMA)
    rows = regions.thickness(px, ["image"]).orderBy("bin").collect()
    assert [(r.image, r.bin) for r in rows] == [("b", k) for k in range(24)]
    assert [(r.bin, r.thickness_milli) for r in rows if r.widest] == [(5, 6000)]
    assert sum(r.pixels for r in rows) == len(set(blade)) and {r.thickness_milli for r in rows if not r.widest} == {0}
    lean = spark.createDataFrame([("l", x, x, 0, 0, 0, 255) for x in range(30)], SCHEMA)
    axis = regions.axes(lean, ["image"]).first()
    assert abs(axis.axis_x - 0.5**0.5) < 1e-9 and abs(axis.axis_y - 0.5**0.5) < 1e-9


def test_sheet_frames(spark):
    """Two by three cells of 2 x 2 with pads of 1: pads belong to none, clear cells are left out, others move up."""
    lit = {(0, 0), (1, 1), (6, 0), (3, 4), (2, 0), (4, 2)}  # the last two lie on pads or beside them
    px = spark.createDataFrame([("s", x, y, x, y, 0, 255 if (x, y) in lit else 0) for x in range(8) for y in range(5)] + [("t", 0, 0, 1, 1, 1, 1)], SCHEMA)
    packing = spark.createDataFrame([("s", 3, 2, 2, 2, 1), ("t", None, None, None, None, None)], "image string, columns long, rows long, cell_w long, cell_h long, pad long")
    got, cells = sheets.sheet_frames(px, packing, "image", start=5)
    assert {r.cell: r.frame_index for r in cells.collect()} == {0: 5, 1: None, 2: 6, 3: None, 4: 7, 5: None}
    assert got.count() == 12 and {(r.frame_index, r.x, r.y) for r in got.where("a > 0").collect()} == {(5, 0, 0), (5, 1, 1), (6, 0, 0), (7, 0, 1)}
    assert sheets.sheet_frames(px, packing, "image", skip_empty=False)[1].where("frame_index IS NULL").count() == 0


def test_regions_broadcast_nothing(spark):
    """Pixels, runs and labels are merged in every query that finds regions, however small Spark takes them to be."""
    done = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    before = {done().apply(i).executionId() for i in range(done().size())}
    px = spark.createDataFrame(pixels("one", ["ooo oo", "o o o ", "ooo oo"]), SCHEMA)
    found = regions.holes(px, ["image"], 6, 3).collect() + regions.part_statistics(px, ["image"], 6, 3).collect()
    assert [found[0].holes, found[0].hole_pixels, len(found)] == [1, 1, 3]
    ran = [done().apply(i) for i in range(done().size())]
    plans = [x.physicalPlanDescription() for x in ran if x.executionId() not in before]
    assert len(plans) > 4 and not any("BroadcastExchange" in p for p in plans)
