"""The store of revisions, exclusive grounding and the plans of joins by equality."""

import itertools
import random

from pyspark.sql import functions as F

from strandwork.operators import clips, documents, revisions, spatial

FILES = "project long, key string, content string, external boolean"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def held(df):
    return sorted(tuple(r) for r in df.select("project", "key", "content", "external").collect())


def test_save_restore_undo(spark):
    one = [(1, "a", "x", False), (1, "b", "x", False), (1, "c", "z", True), (2, "a", "x", False)]
    two = [(1, "a", "x2", False), (1, "c", "z2", True), (1, "d", "new", False), (2, "a", "y", False)]
    first, now = files(spark, one), files(spark, two)
    store = revisions.save(revisions.empty(first), first, "r1")
    assert sorted((r.project, r.content) for r in store.contents.collect()) == [(1, "x"), (1, "z"), (2, "x")]
    again = revisions.save(store, first, "r2")
    assert again.contents.count() == 3 and again.entries.count() == 8
    assert sorted((r.project, r.revision_id, r.sequence) for r in again.revisions.collect()) == [(1, "r1", 1), (1, "r2", 2), (2, "r1", 1), (2, "r2", 2)]
    chosen = store.revisions.where("project = 1").select("project", "revision_id")
    kept, after = revisions.restore(store, now, chosen, "s1")
    assert held(after) == sorted([one[0], one[1], two[1], two[3]])
    assert sorted((r.project, r.revision_id, r.purpose, r.automatic) for r in kept.revisions.where("automatic").collect()) == [(1, "s1", revisions.SAFETY, True)]
    assert held(revisions.restore(store, now, chosen, "s1", external=True)[1]) == sorted([*one[:3], two[3]])
    undone, back = revisions.undo(kept, after, "s2")
    assert held(back) == sorted(two)
    assert held(revisions.undo(undone, back, "s3")[1]) == held(after)
    left = revisions.forget(again, again.revisions.where("revision_id = 'r1'").select("project", "revision_id"))
    assert left.contents.count() == 3 and revisions.unreferenced(left).count() == 0
    alone = revisions.forget(kept, kept.revisions.where("revision_id = 'r1' AND project = 1").select("project", "revision_id"))
    assert sorted((r.project, r.content) for r in alone.contents.collect()) == [(1, "new"), (1, "x2"), (1, "z2"), (2, "x")]


def test_undo_takes_files_of_an_empty_project_away(spark):
    """A project whose files are all gone is restored, and the undo leaves it without files again."""
    first, now = files(spark, [(1, "a", "x", False), (2, "a", "x", False)]), files(spark, [(2, "a", "y", False)])
    store = revisions.save(revisions.empty(first), first, "r1")
    kept, after = revisions.restore(store, now, store.revisions.select("project", "revision_id"), "s1")
    assert held(after) == held(first)
    assert sorted(r.project for r in revisions.latest_safety(kept).collect()) == [1, 2]
    undone, back = revisions.undo(kept, after, "s2")
    assert held(back) == held(now)
    assert held(revisions.undo(undone, back, "s3")[1]) == held(first)


def greedy(boxes, parts, score):
    found, used_b, used_p = set(), set(), set()
    pairs = sorted(((-a, -s, b, p) for b, p in itertools.product(boxes, parts) if (x := score(boxes[b], parts[p])) for a, s in [x]))
    for _, _, b, p in pairs:
        if b not in used_b and p not in used_p:
            found.add((b, p))
            used_b.add(b)
            used_p.add(p)
    return found


def test_exclusive_overlaps(spark):
    """Random boxes, some over many strips, against taking the best pair again and again."""
    rng = random.Random(8)
    for n in (2, 14):
        box = lambda wide: (x := rng.randrange(300), y := rng.randrange(60), x + rng.randrange(20, wide), y + rng.randrange(20, 60))
        boxes = {i: (*box(400), rng.random() < 0.4) for i in range(n)}
        parts = {100 + i: (*box(200), rng.random() < 0.4, rng.randrange(2)) for i in range(n + 3)}

        def score(b, p):
            w, h = min(b[2], p[2]) - max(b[0], p[0]), min(b[3], p[3]) - max(b[1], p[1])
            both, own, other = max(w, 0) * max(h, 0), (b[2] - b[0]) * (b[3] - b[1]), (p[2] - p[0]) * (p[3] - p[1])
            fits = b[4] == p[4] and both / own >= 0.25 and (not b[4] or both / (own + other - both) >= 0.2)
            return (p[5], both / own) if fits else None

        names = ("x1", "y1", "x2", "y2")
        b = spark.createDataFrame([("g", i, *v) for i, v in boxes.items()], f"g string, box_id long, {', '.join(f'b{c} long' for c in names)}, hand boolean")
        p = spark.createDataFrame([("g", i, *v) for i, v in parts.items()], f"g string, part_id long, {', '.join(f'p{c} long' for c in names)}, contact boolean, liked int")
        got = spatial.exclusive_overlaps(b, p, ["g"], F.col("liked"), F.col("hand"), F.col("contact"))
        assert {(r.box_id, r.part_id) for r in got.collect()} == greedy(boxes, parts, score)
        assert spatial.exclusive_overlaps(b.where("false"), p, ["g"], F.col("liked"), F.col("hand"), F.col("contact")).count() == 0


def test_joins_are_on_all_keys(spark):
    """Cuts meet frames by their place, attachments that name a clip meet frames by it."""
    seq = spark.createDataFrame([("a", i, i * i) for i in range(9)], "g string, frame_index long, v long")
    cuts = spark.createDataFrame([("a", "p", 2, 4), ("a", "q", 4, 20), ("a", "none", 5, 3)], "g string, part string, start long, end long")
    got = documents.split_sequence(seq, cuts, ["g"])
    assert sorted((r.part, r.frame_index, r.v) for r in got.collect()) == [("p", 0, 4), ("p", 1, 9), ("p", 2, 16)] + [("q", i - 4, i * i) for i in range(4, 9)]
    frames = spark.createDataFrame([("h/walk", "walk", 0), ("h/run", "run", 0)], "binding string, animation string, frame long")
    attachments = spark.createDataFrame([(1, "", "walk", 0), (2, "", "h/run", 0), (3, "", "", 0), (4, "h/walk:0", "", 9)], "attachment_id long, key string, meta_animation string, meta_frame long")
    out = clips.attachments_of(frames, attachments)
    assert sorted((r.animation, r.attachment_id) for r in out.collect()) == [("run", 2), ("run", 3), ("walk", 1), ("walk", 3), ("walk", 4)]


def test_stored_tables_are_dropped(spark):
    """What a scratch keeps can be read after it, the rest is gone; a dropped table is gone at once."""
    from strandwork.session import dropped, scratch, stored

    exists = lambda df: (lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))(spark._jvm.org.apache.hadoop.fs.Path(df._stored_at))
    outer = stored(spark.range(3), "outer")
    with scratch(spark) as keep:
        inner = stored(outer.where("id > 0"), "inner")
        result = keep(stored(inner.withColumn("x", F.col("id") * 2), "result"))
    assert exists(outer) and exists(result) and not exists(inner)
    assert sorted(r.x for r in result.collect()) == [2, 4]
    dropped(outer, result)
    assert not exists(outer) and not exists(result)


def test_attachments_match_once_and_need_no_distinct(spark):
    """All ways to match at once, by a plain product; ids that stand for several attachments, too."""
    rng = random.Random(6)
    names = ["h/walk", "walk", "h/run", "run", ""]
    frames = [(b, a, f) for b in ("h/walk", "h/run", "walk") for a in ("walk", "run", "h/walk") for f in (0, 1)]
    attachments = [(i % 50, rng.choice(["h/walk:0", "h/walk:1", "walk:0", "h/run:1", "a:b:c:d:run:e:1", ""]), rng.choice(names), rng.randrange(2)) for i in range(60)]

    def named(key):
        parts = key.split(":")
        left = ":".join(parts[:-1])
        return (parts[4] if len(parts) >= 7 else left.split("/", 1)[-1], int(parts[-1])) if len(parts) > 1 else ("", None)

    want = set()
    for b, a, f in frames:
        for i, key, meta, place in attachments:
            name, own = named(key)
            clip = meta or name
            if key == f"{b}:{f}" or ((own if own is not None else place) == f and (clip == "" or clip in (b, a) or name == a)):
                want.add((b, a, f, i))
    out = clips.attachments_of(spark.createDataFrame(frames, "binding string, animation string, frame long"), spark.createDataFrame(attachments, "attachment_id long, key string, meta_animation string, meta_frame long"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_phases_take_two_sorts(spark):
    """Manual sticks at the ends, none, and equal orders, against a plain walk; one sort from each end."""
    rng = random.Random(7)
    rows = [(g, o, rng.random() < 0.4, rng.random()) for g in range(30) for o in rng.choices(range(12), k=rng.randrange(1, 9))]
    out = clips.spread_phases(spark.createDataFrame(rows, "g long, order long, manual boolean, phase double"), ["g"])
    want = []
    for g in range(30):
        s = sorted(r[1:] for r in rows if r[0] == g)
        fixed, low = [(-1, 0.0), *[(i, p) for i, (_, m, p) in enumerate(s) if m], (len(s), 1.0)], None
        for i, (o, m, p) in enumerate(s):
            (a, x), (b, y) = max(k for k in fixed if k[0] < i), min(k for k in fixed if k[0] > i)
            p = p if m else x + (y - x) * (i - a) / (b - a)
            low = p - i * clips.PHASE_STEP if low is None else max(low, p - i * clips.PHASE_STEP)
            want.append((g, o, m, round(i * clips.PHASE_STEP + min(1 - (len(s) - 1) * clips.PHASE_STEP, max(0.0, low)), 9)))
    assert sorted((r.g, r.order, r.manual, round(r.phase, 9)) for r in out.collect()) == sorted(want)
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 2
