"""Manifests, revisions and placements on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from strandwork.operators import manifests


def test_missing_parts_of_a_manifest(spark):
    schema = "k int, profiles array<struct<id:string,kind:string,animations:array<struct<id:string,name:string,type:string,fps:double,frames:array<struct<path:string>>>>>>"
    rows = [
        (1, [("p", None, [(None, "walk", None, 0.0, [("a",), (None,)]), ("run", None, "effect", 24.0, None)]), ("q", "pet", None)]),
        (2, []),
        (3, None),
    ]
    a = manifests.animations_of(spark.createDataFrame(rows, schema), ["k"])
    got = sorted((r.k, r.profile_id, r.kind, r.animation_id, r.name, r.type, r.fps, r.frame_count) for r in a.collect())
    assert got == [(1, "p", "actor", "run", "run", "effect", 24.0, 0), (1, "p", "actor", "walk", "walk", "actor", 12.0, 2)]
    files = spark.createDataFrame([("a",), ("a",)], "path string")
    f = manifests.existing(manifests.frames_of(a), files, "path")
    assert sorted((r.frame_index, r.path, r.exists) for r in f.collect()) == [(0, "a", True), (1, None, False)]
    assert [(r.frame_count, r.generated_count, r.all_generated) for r in manifests.generated(f, ["k"]).collect()] == [(2, 1, False)]


def test_sections(spark):
    e = spark.createDataFrame([("sfx", "p/a:b:3"), ("sfx", "global"), ("sfx", None), ("boxes", "p/a:1")], "section string, key string")
    assert [(r.binding, r.frame) for r in manifests.sections(e, ["sfx"]).collect()] == [("p/a:b", 3)]
    with pytest.raises(ValueError):
        manifests.sections(e, ["sounds"])


def test_restore_and_unchanged(spark):
    now = spark.createDataFrame([("g", "a", "1", False), ("g", "b", "2", None), ("g", "c", "3", True)], "g string, key string, hash string, external boolean")
    then = spark.createDataFrame([("g", "a", "1"), ("g", "d", "4")], "g string, key string, hash string")
    plan = {r.key: r.action for r in manifests.restore_plan(now, then, ["g", "key"]).collect()}
    assert plan == {"a": "same", "b": "remove", "d": "write"}  # c is external
    same = lambda a, b: [r.unchanged for r in manifests.unchanged(a, b, ["g"], ["key"]).collect()]
    assert same(now, then) == [False] and same(now, now) == [True] and same(now.limit(0), then.limit(0)) == []


def test_placement_turns_and_mirrors(spark):
    x = [F.lit(10.0), F.lit(0.0)]
    one = [F.lit(1.0), F.lit(1.0)]
    at = manifests.placement(x, one, F.lit(5.0), [F.lit(2.0), F.lit(2.0)], F.lit(90.0), F.lit(False))
    back = manifests.placement(x, [F.lit(0.0), F.lit(1.0)], F.lit(5.0), one, F.lit(0.0), F.lit(True))
    r = spark.range(1).select(at.alias("a"), back.alias("b")).first()
    assert (round(r.a.x, 9), round(r.a.y, 9), r.a.scale_x, r.a.rotation) == (0.0, 20.0, 2.0, 95.0)
    assert (round(r.b.x, 9), r.b.scale_x, r.b.rotation) == (-10.0, 0.001, -5.0)


def test_resolve_and_background(spark):
    q = spark.createDataFrame([(1, "b", None), (2, "z", "a"), (3, None, "b"), (4, None, "z")], "i int, named string, around string")
    reg = spark.createDataFrame([("b", 2), ("a", 1)], "key string, n int")
    got = {r.i: r.key for r in manifests.resolve(q, reg, "key", "named", "around", ["n"]).collect()}
    assert got == {1: "b", 2: None, 3: "b", 4: "a"}
    corners = [("one", 0, 10.0, 0.9)] + [("grey", i, 0.0, 0.0) for i in range(3)] + [("hue", i, 358.0 + 4 * (i % 2), 0.9) for i in range(9)] + [("mixed", i, 120.0 * i, 0.9) for i in range(3)]
    c = spark.createDataFrame([(g, i, h % 360, s) for g, i, h, s in corners], "g string, frame_index long, h double, s double")
    assert {r.g: r.stable for r in manifests.stable_background(c, ["g"]).collect()} == {"one": False, "grey": True, "hue": True, "mixed": False}


def test_a_spread_just_below_the_limit_is_one_hue(spark):
    """Two hues that deviate by 14.9998 degrees, which rounds to the limit in thousandths, and by 15.0002."""
    apart = lambda deviation: 2 * math.degrees(math.acos(math.exp(-(math.radians(deviation) ** 2) / 2)))
    corners = [(str(d), i, apart(d) * (i % 2), 0.9) for d in (14.9998, 15.0002) for i in range(2)]
    c = spark.createDataFrame(corners, "g string, frame_index long, h double, s double")
    assert {r.g: r.stable for r in manifests.stable_background(c, ["g"]).collect()} == {"14.9998": True, "15.0002": False}
