"""Sequence, document and timeline operators on small hand-made tables, and folds against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import color, text
from strandwork.operators import documents, loops, sequences, spatial, timeline


def seq(spark, values, group="a"):
    return spark.createDataFrame([(group, i, float(v)) for i, v in enumerate(values)], "g string, frame_index long, v double")


def test_holds_drop_repeats_of_the_anchor(spark):
    rows = sequences.duplicate_holds(seq(spark, [10.0, 10, 50, 50, 90]), ["g"], "v").collect()
    assert sorted((r.frame_index, r.match_index) for r in rows) == [(1, 0), (3, 2)]
    assert sequences.duplicate_holds(seq(spark, [1.0, 1.0]), ["g"], "v").count() == 0


def test_holds_against_a_loop(spark):
    rng = random.Random(1)
    for n in (3, 8, 30):
        v = [float(rng.randrange(60)) for _ in range(n)]
        want, anchor = [], 0
        for i in range(1, n):
            if 100 - abs(v[i] - v[i - 1]) >= 88 and 100 - abs(v[i] - v[anchor]) >= 88:
                want.append((i, anchor))
            else:
                anchor = i
        got = sequences.duplicate_holds(seq(spark, v), ["g"], "v").collect()
        assert sorted((r.frame_index, r.match_index) for r in got) == want


def test_suggested_threshold(spark):
    got = sequences.duplicate_holds(seq(spark, [0.0, 20, 90, 30, 99, 160]), ["g"], "v", suggest=True).collect()
    assert [(r.frame_index, r.match_index, r.threshold) for r in got] == [(1, 0, 80.0)]
    even = sequences.duplicate_holds(seq(spark, [0.0, 20, 100, 120, 200, 220, 300, 320]), ["g"], "v", suggest=True)
    assert even.count() == 0  # an even stride over half of the sequence is motion


def test_jump(spark):
    got = sequences.jump_frames(seq(spark, [10.0, 60, 10, 10]), ["g"], "v").collect()
    assert [(r.frame_index, r.score) for r in got] == [(1, 50.0)]


@pytest.mark.parametrize(("v", "want"), [([100.0] * 3 + [150, 160, 150] + [100, 100], (3, 5)), ([100.0, 100, 150, 160], (2, 3)), ([5.0, 5, 5], (0, 2)), ([7.0], (0, 0))])
def test_motion_window(spark, v, want):
    r = sequences.motion_window(seq(spark, v), ["g"], ["v"]).first()
    assert (r.start_frame, r.end_frame) == want


def test_visual_scales(spark):
    rows = sequences.visual_scales(seq(spark, [12.0, 20, 20, 20, 28]), ["g"], "v", 20).orderBy("frame_index").collect()
    assert [(r.scale_milli, r.reason) for r in rows] == [(1667, "zoom")] + [(1000, "group")] * 4


def test_pairs_are_a_band(spark):
    v = [float(i * i % 17) for i in range(25)]
    got = {(r.i, r.j): r.similarity for r in sequences.pair_similarity(seq(spark, v), ["g"], "v", 4).collect()}
    assert got == {(i, j): max(0.0, 100 - abs(v[i] - v[j])) for i in range(25) for j in range(i + 1, min(25, i + 5))}


def plain_loops(m, least=2, prefer="auto"):
    """The loop search on the whole matrix of one sequence, with the hull as the least of all chords."""
    n, most = len(m), 2 * len(m) // 3
    if n < 4:
        return []
    s = [[float(np.float32(max(0.0, 100 - abs(a - b)))) / 100 for b in m] for a in m]
    lags = range(least, min(n - 1, most) + 1)
    acf = {p: float(np.float32(np.mean([s[i][i + p] for i in range(n - p)]))) for p in lags}
    base = {x: float(np.float32(min(acf[a] + (acf[b] - acf[a]) * (x - a) / max(1, b - a) for a in lags if a <= x for b in lags if b >= x))) for x in lags}
    ratio = {p: acf[p] / max(base[p], 1e-300) for p in lags}
    tops = sorted((p for p in lags if base[p] > 0 and ratio[p] > 1 and ratio[p] >= ratio.get(p - 1, 0) and ratio[p] >= ratio.get(p + 1, 0)), key=lambda p: (-acf[p], p))
    chosen, out = [], []
    for p in tops:
        if all(abs(p - q) > 2 for q in chosen):
            chosen.append(p)
            starts = [i for i in range(n - p) if s[i][i + p] >= acf[p] * 0.85]
            if len(starts) >= p / 2:
                seam, i = max((s[i][i + p - 1], -i) for i in starts)
                place = (p - least) / max(1, most - least)
                out.append((acf[p] * seam * {"short": 1 - 0.3 * place, "long": 0.7 + 0.3 * place}.get(prefer, 1.0), p, -i))
    return [x[1:] for x in sorted(out, key=lambda x: -x[0])[:6]]


@pytest.mark.parametrize("prefer", ["auto", "short", "long"])
def test_loops_against_the_whole_matrix(spark, prefer):
    rng = random.Random(7)
    clips = {"short": [1.0, 2.0, 3.0], "flat": [5.0] * 9, "cycle": [10.0, 40.0, 70.0, 90.0, 30.0] * 6}
    clips |= {f"r{k}": [float(rng.randrange(100) if rng.random() < 0.3 else 20.0 * (i % (3 + k))) for i in range(12 + 9 * k)] for k in range(5)}
    table = spark.createDataFrame([(g, i, float(v)) for g, m in clips.items() for i, v in enumerate(m)], "g string, frame_index long, v double")
    got = {g: [] for g in clips}
    for r in loops.loop_candidates(table, ["g"], "v", prefer=prefer).orderBy("g", "rank").collect():
        got[r.g].append((r.period, r.start_frame))
    assert got == {g: plain_loops(m, prefer=prefer) for g, m in clips.items()}
    assert got["cycle"][0][0] % 5 == 0 and got["short"] == got["flat"] == []


def test_autocorrelation_does_not_depend_on_tiles(spark):
    s = seq(spark, [float(i * i % 37) for i in range(40)])
    want = {}
    for p in range(1, 27):
        want[p] = sum(round((100 - abs(i * i % 37 - (i + p) ** 2 % 37)) * 100) for i in range(40 - p))
    for tile in (1, 7, 256):
        assert {r.period: r.similarity_sum for r in sequences.autocorrelation(s, ["g"], "v", tile=tile).collect()} == want
    assert {r.period for r in sequences.autocorrelation(s, ["g"], "v", most=5).collect()} == {1, 2, 3, 4, 5}


def test_reorganize_fans_out(spark):
    b = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "g string, frame_index long, id string")
    order = spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 2, 0)], "g string, new_index long, old_index long")
    got = documents.reorganize(b, order, ["g"]).collect()
    assert sorted((r.g, r.frame_index, r.id) for r in got) == [("a", 0, "y"), ("a", 1, "y"), ("a", 2, "x"), ("b", 0, "z")]


def test_merge_retimes(spark):
    s = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0)], "k string, frame_index long, duration double")
    m = spark.createDataFrame([("a", "m", 0, 12.0), ("b", "m", 1, 24.0)], "k string, merged string, position int, fps double")
    got = documents.merge_sequences(s, m, "k", F.col("fps")).orderBy("frame_index").collect()
    assert [(r.frame_index, r.duration) for r in got] == [(0, 1.0), (1, 1.0), (2, 0.5)]


def test_upsert_and_compare(spark):
    now = spark.createDataFrame([(1, 1.0, True), (2, 3.0, True)], "k long, d double, e boolean")
    patch = spark.createDataFrame([(2, 1.0), (3, 2.0)], "k long, d double")
    got = documents.upsert(now, patch, ["k"], {"d": 1.0, "e": True})
    assert [(r.k, r.d, r.e) for r in got.collect()] == [(3, 2.0, None)]
    changes = documents.compare_revisions(now, documents.upsert(now, patch, ["k"]), ["k"], ["d", "e"])
    assert sorted((r.k, r.status) for r in changes.collect()) == [(2, "changed"), (3, "added")]


def test_interpolation_modes(spark):
    keys = spark.createDataFrame([("a", 0, 0.0, 3.0, "x"), ("a", 4, 8.0, -3.0, "y")], "g string, frame long, v double, r double, layer string")
    run = lambda **k: [(r.v, round(r.r, 6), r.layer) for r in timeline.interpolate(keys, ["g"], ["v"], "r", ["layer"], **k).orderBy("frame").collect()]
    linear = run()
    assert [x[0] for x in linear] == [0, 2, 4, 6, 8] and [x[2] for x in linear] == ["x"] * 4 + ["y"]
    assert abs(linear[2][1] - math.pi) < 1e-6  # the shorter way, through pi
    assert run(shortest=False)[2][1] == 0
    assert [x[0] for x in run(mode="hold")] == [0, 0, 0, 0, 8]
    assert [x[0] for x in run(mode="smooth")][1] == 8 * (3 * 0.0625 - 2 * 0.015625)


def test_pose_is_clamped(spark):
    poses = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 20.0)], "g string, arrival double, v double")
    times = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 1.5, 3.0, 9.0)], "g string, time double")
    got = {r.time: r.v for r in timeline.pose_at(poses, times, ["g"], ["v"]).collect()}
    assert got == {0.0: 10.0, 1.0: 10.0, 1.5: 12.5, 3.0: 20.0, 9.0: 20.0}


def test_delays_and_sweep(spark):
    d = spark.createDataFrame([(0.0,), (0.004,), (0.125,), (700.0,)], "s double")
    assert [r[0] for r in d.select(timeline.delay_centiseconds(F.col("s"))).collect()] == [1, 1, 13, None]
    spans = spark.createDataFrame([("a", 0.0, 0.05)], "g string, arrival double, next_arrival double")
    assert [round(r.time, 4) for r in timeline.sweep_samples(spans, ["g"]).collect()] == [0.0, 0.0167, 0.0333]


def test_spans(spark):
    m = seq(spark, [1.0, 0, 500, 500, 0, 1])
    r = sequences.trimmed_span(m, ["g"], "v").first()
    assert (r.start_pos, r.end_pos) == (2, 3)
    runs = sequences.dense_runs(seq(spark, [9.0] * 4 + [0.0] * 20 + [9.0] * 8), ["g"], "v").first()
    assert (runs.start_pos, runs.end_pos) == (24, 31)
    n = spark.createDataFrame([(50,), (3,), (1,)], "n long")
    got = sequences.even_samples(n, "n", 24).collect()
    assert sorted(r.frame_index for r in got if r.n == 3) == [0, 1, 2] and len([r for r in got if r.n == 50]) == 24


def test_fusion_prefers_affinity(spark):
    boxes = spark.createDataFrame([("f", 1, 0, 0, 10, 10)], "g string, box_id int, bx1 int, by1 int, bx2 int, by2 int")
    parts = spark.createDataFrame([("f", 1, 0, 0, 9, 9, 0), ("f", 2, 0, 0, 6, 6, 2), ("f", 3, 0, 0, 4, 4, 9)], "g string, part_id int, px1 int, py1 int, px2 int, py2 int, a int")
    got = spatial.best_overlaps(boxes, parts, ["g"], F.col("a")).collect()
    assert [(r.part_id, r.share) for r in got] == [(2, 0.36)]


def test_text(spark):
    names = ["f10.png", "f2.png", "F1.png", "f02b.png"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in d.orderBy(text.natural_key(F.col("n")), "n").collect()] == ["F1.png", "f2.png", "f02b.png", "f10.png"]
    d = spark.createDataFrame([("2/3",), ("1/0",), (" 4.5 ",), ("x",), ("",)], "t string")
    assert [r[0] for r in d.select(text.parse_number(F.col("t"))).collect()] == [2 / 3, None, 4.5, None, None]
    d = spark.createDataFrame([("a/b:c d",), ("..",), (None,)], "t string")
    assert [r[0] for r in d.select(text.slug(F.col("t"))).collect()] == ["a-b_c_d", "project", "project"]
    d = spark.createDataFrame([("p/walk:12",), ("odd",)], "t string")
    assert [tuple(r[0]) for r in d.select(text.binding_key(F.col("t"))).collect()] == [("p", "walk", 12), (None, None, None)]


def test_color(spark):
    d = spark.createDataFrame([(255, 0, 0), (0, 0, 0), (255, 255, 255), (12, 200, 99)], "r int, g int, b int")
    r, g, b = (F.col(c) for c in "rgb")
    rows = d.select("r", color.oklab(r, g, b).alias("o"), color.hsv(r, g, b).alias("h"), color.rgb_to_hex(r, g, b).alias("x"), color.perceptual_distance([r, g, b], [r, g, b]).alias("zero"), color.perceptual_distance([r, g, b], [F.lit(255), F.lit(255), F.lit(255)]).alias("far")).collect()
    assert abs(rows[2].o.l - 1) < 1e-3 and rows[1].o.l == 0 and rows[0].h == (0.0, 1.0, 1.0) and rows[3].x == "#0cc863"
    assert all(x.zero == 0 for x in rows) and rows[1].far > 60
    back = d.select(color.hex_to_rgb(color.rgb_to_hex(r, g, b)).alias("c"), color.linear_to_srgb(color.srgb_to_linear(r)).alias("s"), "r").collect()
    assert [x.c for x in back] == [[255, 0, 0], [0, 0, 0], [255, 255, 255], [12, 200, 99]] and all(x.s == x.r for x in back)
