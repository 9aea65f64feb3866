"""File sources: PNG folders, explicit lists, inline items, sprite-frame resources, JSON documents and scripts."""

import base64

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.sources import documents, frames


def test_png_sequence_and_items(spark, tmp_path):
    for n in ("f10", "f2", "f1"):
        (tmp_path / f"{n}.png").write_bytes(n.encode())
    (tmp_path / "notes.txt").write_text("no frame")
    seq = frames.png_sequence(spark, str(tmp_path))
    assert [(r.name, bytes(r.content)) for r in seq.orderBy("frame_index").collect()] == [("f1.png", b"f1"), ("f2.png", b"f2"), ("f10.png", b"f10")]
    url = "data:image/png;base64," + base64.b64encode(b"bytes").decode()
    items = spark.createDataFrame([(url,), ("x",)], "data_url string")
    assert [r.content is not None for r in frames.inline_items(items).collect()] == [True, False]
    at = [str(tmp_path / n) for n in ("f2.png", "f10.png", "f2.png")]
    got = documents.listed_files(spark, at).orderBy("place").collect()
    assert [(r.place, r.path, bytes(r.content)) for r in got] == [(0, at[0], b"f2"), (1, at[1], b"f10"), (2, at[2], b"f2")]


TRES = """[gd_resource type="SpriteFrames"]
[ext_resource type="Texture2D" path="res://a/0.png" id="1_x"]
[ext_resource type="Texture2D" path="res://a/1.png" id="2_y"]
[resource]
animations = [{
"frames": [{
"duration": 1.5,
"texture": ExtResource("2_y")
}, {
"duration": 1.0,
"texture": ExtResource("1_x")
}],
"loop": true,
"name": &"walk",
"speed": 8.0
}]
"""


def test_sprite_frames(spark, tmp_path):
    (tmp_path / "hero.tres").write_text(TRES)
    rows = frames.sprite_frames(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert [(r.animation, r.speed, r.duration, r.texture) for r in rows] == [("walk", 8.0, 1.5, "res://a/1.png"), ("walk", 8.0, 1.0, "res://a/0.png")]


def test_json_files(spark, tmp_path):
    """Good, cut off, of another kind, empty and missing documents, one with a byte order mark."""
    given = {"a.json": '{"n": 3, "s": "x"}', "b.json": '{"n": 3, ', "c.json": "[1, 2]", "d.json": "", "e.json": '﻿{"n": 4}', "f.json": '{"n": "no number"}'}
    for n, t in given.items():
        (tmp_path / n).write_text(t, encoding="utf-8")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])
    got = documents.json_files(spark, str(tmp_path), [*given, "gone.json"], schema, {"n": 7})
    rows = {r.name: (r.state, r.n, r.s) for r in got.collect()}
    corrupt = ("corrupt", None, None)
    assert rows == {"a.json": ("good", 3, "x"), "b.json": corrupt, "c.json": corrupt, "d.json": ("missing", 7, None), "e.json": ("good", 4, None), "f.json": corrupt, "gone.json": ("missing", 7, None)}
    texts = documents.parsed_documents(spark.createDataFrame([("",), (" \n",)], "t string"), "t", schema)
    assert [r.state for r in texts.collect()] == ["corrupt"] * 2
    assert {r.name: r.text for r in got.where("state = 'corrupt'").collect()}["b.json"] == given["b.json"]


def test_scripts(spark, tmp_path):
    text = "var a = PackedVector2Array([Vector2(0, -10), Vector2(1.5,30.5)])\nPackedVector2Array([Vector2(0, 1)])\nCapsuleShape2D\nx.height = 48\ny.height=9\nr.size = Vector2(4, 100)"
    for at, t in {"a.gd": text, "sub/b.TSCN": "x.height = 50", "addons/c.gd": text, "sub/.git/d.gd": text, "e.txt": text}.items():
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(t)
    scripts = documents.script_texts(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in scripts.collect()) == ["a.gd", "b.TSCN"]
    got = documents.script_heights(scripts, ["path"])
    assert sorted((r.path.rsplit("/", 1)[1], r.kind, r.height) for r in got.collect()) == [("a.gd", "height", 48.0), ("a.gd", "size", 100.0), ("a.gd", "span", 40.5)]
    assert documents.script_heights(scripts.where(F.lit(False)), ["path"]).count() == 0
