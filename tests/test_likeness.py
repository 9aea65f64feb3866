"""Frames as vectors: similarities by tiles and as a column against plain sums, holds and loops on pixels, analysis plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import analysis, likeness, loops, sequences

SCHEMA = "clip string, frame_index long, x int, y int, r int, g int, b int, a int"


def solid(clip, place, colour, side=8):
    return [(clip, place, x, y, *colour, 255) for x in range(side) for y in range(side)]


def plain(p, q):
    """Frames as rows (r, g, b, a, out, clear)."""
    total = n = 0
    for s, t in zip(p, q, strict=True):
        if (s[4] and t[4]) or (s[5] and t[5]):
            continue
        n += 1
        u, v = ((lambda k: k * k * (3 - 2 * k))(min(a / 40, 1)) for a in (s[3], t[3]))
        total += u * v * sum((s[c] * (s[3] / 255) - t[c] * (t[3] / 255)) ** 2 for c in range(3)) / 3 + (u - v) ** 2 * 255 * 255 / 4
    return (1 - math.sqrt(total / n) / 255) * 100 if n else 100.0


def test_tiles_and_columns(spark):
    rng = random.Random(2)
    frames = [[tuple(float(rng.choice((0, 20, 39, 200, 255))) for _ in range(4)) + (float(rng.random() < 0.3), float(rng.random() < 0.3)) for _ in range(12)] for _ in range(7)]
    frames += [frames[0], [(0.0, 0.0, 0.0, 0.0, 1.0, 1.0)] * 12]
    kind = "clip string, frame_index long, pixels array<struct<r:double,g:double,b:double,a:double,out:double,clear:double>>"
    table = spark.createDataFrame([("c", i, f) for i, f in enumerate(frames)] + [("one", 0, frames[1])], kind)
    want = {(i, j): plain(frames[i], frames[j]) for i in range(9) for j in range(i + 1, 9)}
    for tile in (1, 2, 32):
        got = {(r.i, r.j): r.similarity for r in likeness.pair_similarities(table, ["clip"], tile=tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    near = likeness.pair_similarities(table, ["clip"], 2, tile=2).collect()
    assert {(r.i, r.j) for r in near} == {k for k in want if k[1] - k[0] <= 2}
    lags = {r.period: (r.n, r.similarity_sum) for r in likeness.pair_similarities(table, ["clip"], by_lag=True, units=1000, tile=2).where("clip = 'c'").collect()}
    assert lags == {d: (9 - d, sum(math.floor(want[i, i + d] * 1000 + 0.5) for i in range(9 - d))) for d in range(1, 9)}
    both = table.where("clip = 'c'").alias("p").join(table.where("clip = 'c'").alias("q"), F.col("p.frame_index") < F.col("q.frame_index"))
    for r in both.select(F.col("p.frame_index").alias("i"), F.col("q.frame_index").alias("j"), likeness.frame_similarity(F.col("p.pixels"), F.col("q.pixels")).alias("s")).collect():
        assert abs(r.s - want[r.i, r.j]) < 1e-9
    assert np.isclose(plain(frames[0], frames[7]), 100)


def test_a_stable_background_is_not_compared(spark):
    """Green screens with a figure that moves; the same figure before clips of changing colour counts as a whole."""
    def clip(name, screens):
        return [(name, i, x, y, *((200, 30, 30) if x == 8 + i and y in range(6, 12) else screens[i]), 255) for i in range(3) for x in range(20) for y in range(20)]

    green, mixed = [(20, 220, 30)] * 3, [(20, 220, 30), (220, 20, 30), (20, 30, 220)]
    px = spark.createDataFrame(clip("green", green) + clip("mixed", mixed), SCHEMA)
    v = likeness.vectors(px, ["clip"], 20, 20, 4)
    masked = {(r.clip, r.frame_index): (r.out, r.n) for r in v.select("clip", "frame_index", F.expr("aggregate(pixels, 0D, (s, p) -> s + p.out)").alias("out"), F.size("pixels").alias("n")).collect()}
    assert masked["green", 0] == (394.0, 400) and masked["mixed", 0] == (0.0, 400)
    s = {(r.clip, r.i, r.j): r.similarity for r in likeness.pair_similarities(v, ["clip"]).collect()}
    assert s["green", 0, 1] < 60 and s["green", 0, 1] == pytest.approx(s["green", 1, 2])


def test_holds_and_loops_of_frames(spark):
    """Five solids A A B B C drop the second of each pair; three colours in turn have the period 3."""
    a, b, c = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    held = [r for i, colour in enumerate((a, a, b, b, c)) for r in solid("held", i, colour)]
    turning = [r for i in range(9) for r in solid("turning", i, (a, b, c)[i % 3])]
    v = likeness.vectors(spark.createDataFrame(held + turning, SCHEMA), ["clip"], 8, 8, 2).cache()
    holds = sequences.duplicate_holds(v.where("clip = 'held'"), ["clip"], "pixels", 88.0, likeness.frame_similarity)
    assert sorted((r.frame_index, r.match_index) for r in holds.collect()) == [(1, 0), (3, 2)]
    lags = likeness.pair_similarities(v, ["clip"], by_lag=True).where("period <= floor(frames * 2 / 3)")
    found = loops.loop_candidates(v.where("clip = 'turning'"), ["clip"], "pixels", sim=likeness.frame_similarity, lags=lags.where("clip = 'turning'")).orderBy("rank").first()
    assert (found.period, found.start_frame) == (3, 0)


def test_holds_are_cut_where_frames_differ(spark):
    """Slow drift: each frame is like the one before, but not like the anchor for ever."""
    v = [0, 5, 10, 15, 20, 25, 30, 200, 203, 400, 401, 402]
    seq = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 0, 1.0), ("b", 1, 1.0)], "g string, frame_index long, v double")
    want, anchor = [], 0
    for i in range(1, len(v)):
        if abs(v[i] - v[i - 1]) <= 12 and abs(v[i] - v[anchor]) <= 12:
            want.append((i, anchor))
        else:
            anchor = i
    assert sorted((r.frame_index, r.match_index) for r in sequences.duplicate_holds(seq, ["g"], "v").collect()) == want


def test_raised_jump_threshold(spark):
    seq = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate((0, 8.5, 0, 5, 0))] + [("b", i, float(i)) for i in range(4)], "g string, frame_index long, v double")
    assert sequences.jump_frames(seq, ["g"], "v").count() == 0
    assert [(r.frame_index, r.score, r.threshold) for r in sequences.jump_frames(seq, ["g"], "v", suggest=True).collect()] == [(1, 8.5, 92.0)]


def test_analysis_shuffles_once(spark):
    seq = spark.createDataFrame([(g, i, float((i * 7 + g) % 50)) for g in range(5) for i in range(20)], "g long, frame_index long, v double").repartition(3)
    out = analysis.analyse(seq, ["g"], "v")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = analysis.analyse(seq, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert plan.count("Exchange hashpartitioning") == 1
    holds = {(r.g, h.frame_index, h.match_index) for r in out.collect() for h in r.holds}
    assert holds == {(r.g, r.frame_index, r.match_index) for r in sequences.duplicate_holds(seq, ["g"], "v").collect()}
    jumps = {(r.g, j.frame_index) for r in out.collect() for j in r.jumps}
    assert jumps == {(r.g, r.frame_index) for r in sequences.jump_frames(seq, ["g"], "v").collect()}


def small_frames(spark, clips):
    """Frames of two pixels in grey: clips of (name, greys)."""
    kind = "clip string, frame_index long, pixels array<struct<r:double,g:double,b:double,a:double,out:double,clear:double>>"
    return spark.createDataFrame([(c, i, [(float(v),) * 3 + (255.0, 0.0, 0.0)] * 2) for c, greys in clips for i, v in enumerate(greys)], kind)


def test_holds_of_long_stretches_pass_by(spark):
    """One drifting stretch longer than a block, a clip that is cut often, one all alike, and clips of two frames."""
    rng = random.Random(4)
    clips = [("drift", [i * 0.25 for i in range(700)]), ("cut", [rng.choice((0, 3, 40, 42.5, 90)) for _ in range(300)]), ("still", [7] * 600), ("two", [5, 5]), ("three", [5, 5, 5])]
    want = set()
    for name, v in clips:
        alike, anchor = lambda a, b: (1 - abs(a - b) / 255) * 100 >= 98, 0
        for i in range(1, len(v)):
            if alike(v[i], v[i - 1]) and alike(v[i], v[anchor]):
                want |= {(name, i, anchor)} if len(v) >= 3 else set()
            else:
                anchor = i
    got = [tuple(r) for r in likeness.duplicate_holds(small_frames(spark, clips), ["clip"], 98.0).select("clip", "frame_index", "match_index").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_frames_are_sent_to_few_tiles_and_packed(spark):
    frames = small_frames(spark, [("c", [i % 251 for i in range(1100)])])
    sent = likeness._tiles(frames, ["clip"], None, likeness.TILE)
    assert sent.count() <= 3 * 1100 and max(len(r.pixels) for r in sent.select("pixels").collect()) == 1 + 2 * 6
    pairs = likeness.pair_similarities(frames, ["clip"]).agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("d"), F.min(F.col("j") - F.col("i")).alias("least")).first()
    assert tuple(pairs) == (1100 * 1099 // 2, 1100 * 1099 // 2, 1)


def test_copies_of_a_frame_do_not_grow_with_its_clip(spark):
    """F1 of round 4: in tiles of a fixed 512 frames, each of these would be sent 40 times."""
    frames = small_frames(spark, [("long", [0])]).select("clip", F.explode(F.expr("sequence(0L, 19999L)")).alias("frame_index"), "pixels")
    sent = likeness._tiles(frames.union(small_frames(spark, [("short", range(5))])), ["clip"], None, None)
    copies = {r.clip: r.n for r in sent.groupBy("clip").agg(F.count("*").alias("n")).collect()}
    assert copies == {"long": 20_000 * likeness.ROWS, "short": 5}


@pytest.mark.parametrize(("flags", "side"), [("none", 4), ("out", 3), ("nested", 5), ("any", 4), ("everywhere", 4)])
def test_blocks_of_a_tile(monkeypatch, flags, side):
    """Pairs of two blocks with gaps between the places, some frames at a time, against plain sums."""
    monkeypatch.setattr(likeness, "SIDE", side), monkeypatch.setattr(likeness, "STRIP", 2), monkeypatch.setattr(likeness, "PIXELS", 5)
    rng = np.random.default_rng(3)
    px = rng.choice([0, 20, 39, 200, 255], (14, 12, 6)).astype(np.uint8)
    px[..., 4], px[..., 5] = rng.random((2, 14, 12)) < 0.4
    px[..., 4] |= np.uint8(flags == "everywhere")
    px[..., 4] &= np.uint8(flags != "none")
    px[..., 5] &= {"none": px[..., 3] == 0, "out": False, "nested": px[..., 4], "any": 1, "everywhere": 1}[flags]
    px[1, :, 4] = px[2, :, 4] = flags != "none"  # nothing of the two is compared
    places = np.array([0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 14, 15, 16])
    want = {(int(i), int(j)): plain(px[a].astype(float), px[b].astype(float)) for a, i in enumerate(places) for b, j in enumerate(places) if i < j}
    for most in (None, 5):
        got = {}
        for row, col in ((0, 0), (0, 1), (1, 1)):
            for x, y, s in likeness._met(places, px, 9, row, col, most):
                for i, first, n, likes in likeness._runs(x, y, s, most):
                    pairs = [(int(a), int(b) + k) for a, b, m in zip(i, first, n, strict=True) for k in range(m)]
                    assert len(pairs) == len(likes) and not got.keys() & set(pairs)
                    got |= dict(zip(pairs, likes.tolist(), strict=True))
        assert got.keys() == {k for k in want if most is None or k[1] - k[0] <= most}
        assert all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_packed_images_are_masked_as_vectors(spark):
    """Green and grey screens, changing ones, one that only some frames show, a clip of one frame, clear pixels."""
    rng = random.Random(6)
    screens = {
        "green": lambda i, x, y: (20, 220 - i, 30, 255), "grey": lambda i, x, y: (100, 100, 101, 40 + i), "mixed": lambda i, x, y: (*[(220, 20, 20), (20, 220, 20), (20, 20, 220)][i % 3], 255),
        "some": lambda i, x, y: (20, 220, 30, 255) if i in (0, 1, 3, 4, 6) or x < 2 else tuple(rng.randrange(256) for _ in range(4)), "one": lambda i, x, y: (20, 220, 30, 255),
    }
    px = []
    for name, screen in screens.items():
        for i in range(1 if name == "one" else 7):
            for y in range(6):
                for x in range(8):
                    inner = 2 <= x < 6 and 2 <= y < 4 and rng.random() < 0.7
                    px.append((name, i, x, y, *([rng.choice((0, 30, 64, 65, 200)) for _ in range(4)] if inner else screen(i, x, y))))
    v = likeness.packed(likeness.vectors(spark.createDataFrame(px, SCHEMA), ["clip"], 8, 6, 2)).collect()
    whole = {}
    for name, i, _, _, *rgba in px:
        whole[name, i] = whole.get((name, i), b"") + bytes(rgba)
    images = spark.createDataFrame([(*k, bytearray(b)) for k, b in whole.items()], "clip string, frame_index long, rgba binary")
    want, got = ({(r.clip, r.frame_index): bytes(r.pixels) for r in rows} for rows in (v, likeness.masked(images, ["clip"], 8, 2).collect()))
    assert got == want
    assert {k: (sum(want[k][5::6]), sum(want[k][6::6])) for k in want}["green", 0][0] > 30


def test_images_are_frames(spark):
    from strandwork.plans import likeness as plans

    sf_dir = "/root/testdata/sf0.001"
    want, got = ({(r.label, r.frame_index): bytes(r.pixels) for r in df.collect()} for df in (likeness.packed(plans.frames(spark, sf_dir)), plans.images(spark, sf_dir)))
    assert len(got) == 500 and got == want
