"""Nested manifests as rows, what belongs to a clip, saved revisions, and the placing of what is bound to frames."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.color import clamp
from strandwork.operators.rasters import circular

#: Frames a second and kind where a manifest names none.
FPS, KIND = 12.0, "actor"
#: The parts of a clip that can be asked for.
SECTIONS = ("boxes", "timing", "visual", "sfx", "attachments", "trails")
#: Chase multipliers before and after a stop, the old speeds that equalled them, and the least tail.
BEFORE, AFTER, BEFORE_SPEED, AFTER_SPEED, SMEAR = 0.12, 2.0, 110.0, 680.0, 36.0
#: The saturation from which a corner has a colour, the share that decides, the spread of one hue.
SATURATION, SHARE, HUE = 0.15, 0.6, 15.0
#: How far a neutral colour's channels lie apart, and how far green leads in a green one.
NEUTRAL = 24
#: Fixed values of a proposal: an effect's width by its owner's with limits; how far it stands aside and below, by the
#: owner's box; the certainty of a told side and the limits of a guessed one; that of canvases alike, of others, the
#: weight of the side, and the limits of all.
WIDTH, WIDTHS, ASIDE, BELOW, TOLD, GUESSED, ALIKE, OTHERS, WEIGHT, CERTAIN = 1.15, (0.25, 1.25), 0.45, 0.08, 0.95, (0.2, 0.75), 0.72, 0.58, 0.2, (0.6, 0.91)


def animations_of(manifests: DataFrame, keep: Sequence[str]) -> DataFrame:
    """manifests: keep and profiles (id, kind, animations (id, name, type, fps, frames)) -> a row an animation, with its
    frames; what is missing gets its default. Manifests or profiles without animations have no rows."""
    p = manifests.select(*keep, F.explode("profiles").alias("p"))
    a = p.select(*keep, F.col("p.id").alias("profile_id"), F.coalesce("p.kind", F.lit(KIND)).alias("kind"), F.explode("p.animations").alias("a"))
    return a.select(
        *keep,
        "profile_id",
        "kind",
        F.coalesce("a.id", "a.name").alias("animation_id"),
        F.coalesce("a.name", "a.id", F.lit("")).alias("name"),
        F.coalesce("a.type", F.lit(KIND)).alias("type"),
        F.coalesce(F.when(F.col("a.fps") != 0, F.col("a.fps")), F.lit(FPS)).alias("fps"),
        F.coalesce(F.size("a.frames"), F.lit(0)).cast("long").alias("frame_count"),
        F.col("a.frames").alias("frames"),
    )


def frames_of(animations: DataFrame) -> DataFrame:
    """Each animation's frames as rows with their places; the frame's fields become columns."""
    rest = [c for c in animations.columns if c != "frames"]
    return animations.select(*rest, F.posexplode("frames").alias("frame_index", "frame")).select(*rest, F.col("frame_index").cast("long").alias("frame_index"), "frame.*")


def existing(frames: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """frames with exists: whether files, a listing with the same column, has the path. No path, no file."""
    there = files.select(path).distinct().withColumn("_there", F.lit(True))
    return frames.join(there, path, "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def generated(frames: DataFrame, clips: Sequence[str]) -> DataFrame:
    """Frames of each clip, those that exist, and whether all do."""
    n = F.count_if("exists")
    return frames.groupBy(*clips).agg(F.count("*").alias("frame_count"), n.alias("generated_count"), (n == F.count("*")).alias("all_generated"))


def sections(entries: DataFrame, wanted: Sequence[str], key: str = "key") -> DataFrame:
    """entries (section, key ``binding:frame`` and more) of the wanted sections, with binding and frame. Keys of another
    form belong to no frame and are left out; an unknown section raises."""
    unknown = set(wanted) - set(SECTIONS)
    if unknown:
        raise ValueError(f"no such section: {', '.join(sorted(unknown))}")
    form = r"^(.+):(\d+)$"
    part = lambda i: F.regexp_extract(key, form, i)
    return entries.where(F.col("section").isin(*wanted) & F.col(key).rlike(form)).withColumn("binding", part(1)).withColumn("frame", part(2).cast("long"))


def duration_ms(duration: Column, fps: Column) -> Column:
    """A frame's duration in milliseconds, halves up; none or zero counts as one frame."""
    return F.floor(F.coalesce(F.when(duration != 0, duration), F.lit(1.0)) * 1000 / fps + 0.5).cast("long")


def usable_segment(enabled: Column, rendered: Column, mode: Column, path_kind: Column, sticks: Column, sweep: bool = False) -> Column:
    """Whether a trail's segment is drawn as a sweep, or else as a mesh. Null flags count as set."""
    on = F.coalesce(enabled, F.lit(True)) & (sticks >= 2)
    swept = F.coalesce(mode == "sweep", F.lit(False))
    if sweep:
        return on & swept
    return on & F.coalesce(rendered, F.lit(True)) & ~swept & (F.coalesce(path_kind, F.lit("")) != "polyline")


def plate(r: Column, g: Column, b: Column) -> Column:
    """A neutral background colour."""
    return F.greatest(r, g, b) - F.least(r, g, b) <= NEUTRAL


def keyable(r: Column, g: Column, b: Column) -> Column:
    """A background that can be keyed out: neutral, or clearly green."""
    return plate(r, g, b) | ((g > r + NEUTRAL) & (g > b + NEUTRAL))


def resolve(requests: DataFrame, registry: DataFrame, key: str, explicit: str, context: str, order: Sequence[str]) -> DataFrame:
    """requests with the registry's key that each means: the one it names (null if there is none), else that of its
    context if there is one, else the first in order."""
    have = registry.select(key).distinct()
    named = have.select(F.col(key).alias(explicit), F.lit(True).alias("_named"))
    around = have.select(F.col(key).alias(context), F.lit(True).alias("_around"))
    first = registry.orderBy(*order).limit(1).select(key).scalar()
    out = requests.join(named, explicit, "left").join(around, context, "left")
    found = F.when(F.col(explicit).isNotNull(), F.when(F.col("_named"), F.col(explicit))).when(F.col("_around"), F.col(context)).otherwise(first)
    return out.withColumn(key, found).drop("_named", "_around")


def against(seq: DataFrame, references: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """seq with each measure's difference to its group's reference row, which may come from another clip."""
    ref = references.select(*groups, *[F.col(m).alias(f"_{m}") for m in measures])
    out = seq.join(ref, list(groups), "left")
    return out.select(*seq.columns, *[(F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta") for m in measures])


def shift_points(points: DataFrame, shifts: DataFrame, keys: Sequence[str], xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    """points moved with the pixels of their frames: shifts has keys, dx and dy; frames without one stay."""
    moved = points.join(shifts.select(*keys, "dx", "dy"), list(keys), "left")
    by = {**dict.fromkeys(xs, "dx"), **dict.fromkeys(ys, "dy")}
    return moved.select([(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(by[c]), F.lit(0))).alias(c) if c in by else F.col(c) for c in points.columns])


def revision_list(files: DataFrame, revisions: Sequence[str]) -> DataFrame:
    """How many files and bytes each revision holds, and how many bytes of content it does not share within itself."""
    once = files.groupBy(*revisions, "hash").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"), F.max("size").alias("_one"))
    return once.groupBy(*revisions).agg(F.sum("_n").alias("file_count"), F.sum("_size").alias("bytes"), F.sum("_one").alias("stored_bytes"))


def restore_plan(current: DataFrame, saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and action: write what the revision has (``same`` where the content is there already), remove what came
    after it. current and saved: keys and hash; external files of current (a boolean column) are never removed."""
    a = current.select(*keys, F.col("hash").alias("_now"), F.coalesce("external", F.lit(False)).alias("_external"))
    both = a.join(saved.select(*keys, F.col("hash").alias("_then")), list(keys), "full_outer")
    gone = F.col("_then").isNull()
    action = F.when(gone, "remove").when(F.col("_now").eqNullSafe(F.col("_then")), "same").otherwise("write")
    return both.where(~(gone & F.col("_external"))).select(*keys, action.alias("action"))


def unchanged(current: DataFrame, saved: DataFrame, groups: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """groups and unchanged: whether the files of now are those that were saved, none more, none less."""
    a, b = current.select(*groups, *keys, F.col("hash").alias("_now")), saved.select(*groups, *keys, F.col("hash").alias("_then"))
    both = a.join(b, [*groups, *keys], "full_outer")
    return both.groupBy(*groups).agg(F.bool_and(F.col("_now").eqNullSafe(F.col("_then"))).alias("unchanged"))


def placement(offset: Sequence[Column], scale: Sequence[Column], rotation: Column, owner: Sequence[Column], owner_rotation: Column, flip: Column, world: Column | float = 1.0) -> Column:
    """Struct (x, y, scale_x, scale_y, rotation): an attachment under its owner. The owner's scale (two columns) stretches
    the offset, a flip mirrors it and the turn; rotations are in degrees. Scales are no less than a thousandth."""
    world = world if isinstance(world, Column) else F.lit(world)
    facing = F.when(flip, -1.0).otherwise(1.0)
    least = lambda s: F.greatest(F.lit(0.001), s)
    ox, oy = offset[0] * owner[0] * world * facing, offset[1] * owner[1] * world
    turn = owner_rotation * facing * math.pi / 180
    return F.struct(
        (ox * F.cos(turn) - oy * F.sin(turn)).alias("x"),
        (ox * F.sin(turn) + oy * F.cos(turn)).alias("y"),
        least(owner[0] * least(scale[0]) * world).alias("scale_x"),
        least(owner[1] * least(scale[1]) * world).alias("scale_y"),
        ((owner_rotation + rotation) * facing).alias("rotation"),
    )


def layer_order(order: Column, layer: Column) -> Column:
    """The signed order of a layer: its number unless that is none or zero, else -1 below and 1 above."""
    return F.when(F.abs(order) > 0.0001, order).otherwise(F.when(layer == "below", -1.0).otherwise(1.0))


def proposal(owner: dict[str, Column], other: dict[str, Column], direction: Column) -> Column:
    """Struct (scale, x, y, direction, confidence): a transform that sets an effect beside its owner.

    owner, other: canvas (width, height) and visible box (box_width, box_height, centre_x, centre_y). direction: left,
    right, or anything else for the side of the canvas' middle that the owner leans to.
    """
    lean = owner["centre_x"] - owner["width"] / 2
    told = direction.isin("left", "right")
    sign = F.when(direction == "left", -1).when(direction == "right", 1).when(lean >= 0, 1).otherwise(-1)
    scale = clamp(owner["box_width"] * WIDTH / other["box_width"], *WIDTHS)
    to = (owner["centre_x"] + sign * owner["box_width"] * ASIDE, owner["centre_y"] + owner["box_height"] * BELOW)
    at = [other[s] / 2 + (other[c] - other[s] / 2) * scale for s, c in (("width", "centre_x"), ("height", "centre_y"))]
    sure = F.when(told, TOLD).otherwise(clamp(F.abs(lean) / F.greatest(F.lit(1.0), owner["box_width"] * 0.2), *GUESSED))
    shared = (owner["width"] == other["width"]) & (owner["height"] == other["height"])
    thousandth = lambda v: F.floor(v * 1000 + 0.5) / 1000
    return F.struct(
        thousandth(scale).alias("scale"),
        F.floor(to[0] - at[0] + 0.5).cast("long").alias("x"),
        F.floor(to[1] - at[1] + 0.5).cast("long").alias("y"),
        F.when(sign > 0, "right").otherwise("left").alias("direction"),
        thousandth(clamp(F.when(shared, ALIKE).otherwise(OTHERS) + sure * WEIGHT, *CERTAIN)).alias("confidence"),
    )


def stick_pose(top: Column, bottom: Column, reverse: Column) -> Column:
    """Struct (top, bottom, centre) of points (x, y), the ends swapped where the stick is reversed."""
    a, b = F.when(reverse, bottom).otherwise(top), F.when(reverse, top).otherwise(bottom)
    centre = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return F.struct(a.alias("top"), b.alias("bottom"), centre.alias("centre"))


def chase(direct: Column, speed: Column, before: bool, schema: Column | int = 6) -> Column:
    """The chase multiplier before or after a stop: its own within limits, else the old speed's share of the default, else
    the default. Documents of older schemas wrote 0.7 for the default before a stop."""
    usual, old, low, high = (BEFORE, BEFORE_SPEED, 0, 1) if before else (AFTER, AFTER_SPEED, 0.1, 20)
    own = clamp(direct, low, high)
    if before:
        schema = schema if isinstance(schema, Column) else F.lit(schema)
        own = F.when((schema < 6) & (F.abs(own - 0.7) < 0.000001), usual).otherwise(own)
    return F.when(direct.isNotNull(), own).when(speed.isNotNull(), clamp(speed / old * usual, low, high)).otherwise(float(usual))


def tail_start(distance: Column, multiplier: Column, smear: Column | float = SMEAR) -> Column:
    """Where along its path a trail's tail begins: chased by the multiplier, but a least length behind the head."""
    smear = smear if isinstance(smear, Column) else F.lit(smear)
    head = F.greatest(F.lit(0.0), distance)
    pace = clamp(multiplier, 0, 1)
    keep = F.greatest(F.lit(8.0), F.coalesce(F.when(smear != 0, smear), F.lit(SMEAR)))
    chased = pace * head
    return F.when((pace <= 0) | (head <= 0), 0.0).when(head <= keep, chased).otherwise(F.least(chased, head - keep))


def looked_at(n: Column) -> Column:
    """The five places of a clip of n frames that ``stable_background`` looks at, or all."""
    zero = F.lit(0).cast("long")
    return F.when(n <= 5, F.sequence(zero, n - 1)).otherwise(F.array(zero, *[F.floor(n * q).cast("long") for q in (0.25, 0.5, 0.75)], n - 1))


def stable_background(corners: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups and stable: whether a clip's corners (frame_index, h in degrees, s) have one colour to key out.

    Five frames of a clip are looked at, first and last and the quarters; most of their corners must be of one hue, or
    grey. Clips of a single frame are not stable.
    """
    n = F.col("_n")
    of = corners.groupBy(*groups).agg((F.max("frame_index") + 1).alias("_n"))
    wanted = of.where("_n > 1").select(*groups, F.explode(looked_at(n)).alias("frame_index"))
    seen = corners.join(wanted, [*groups, "frame_index"])
    spread = circular(seen.where(F.col("s") >= SATURATION), groups, F.col("h")).select(*groups, (F.col("deviation") < HUE).alias("_one"))
    share = F.count_if(F.col("s") >= SATURATION) / F.count("*")
    votes = of.join(seen.groupBy(*groups).agg(share.alias("_share")), list(groups), "left").join(spread, list(groups), "left")
    stable = F.when(F.col("_share") >= SHARE, F.col("_one")).otherwise(1 - F.col("_share") >= SHARE)
    return votes.select(*groups, F.coalesce(stable, F.lit(False)).alias("stable"))


def first_seen(df: DataFrame, groups: Sequence[str], values: str, order: Sequence[str]) -> DataFrame:
    """The distinct values of arrays, in the order in which a group's rows bring them: groups, value, place (from 0)."""
    each = df.select(*groups, F.posexplode(values).alias("_i", "value"), F.struct(*order).alias("_row"))
    first = each.groupBy(*groups, "value").agg(F.min(F.struct("_row", "_i")).alias("_first"))
    return first.withColumn("place", F.row_number().over(W.partitionBy(*groups).orderBy("_first")).cast("long") - 1).drop("_first")


def audio_type(path: Column) -> Column:
    """The media type of a sound file, null for other files."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kinds = {"wav": "audio/wav", "ogg": "audio/ogg", "mp3": "audio/mpeg"}
    out = F.lit(None).cast("string")
    for name, kind in kinds.items():
        out = F.when(extension == name, kind).otherwise(out)
    return out


def canonical(document: Column) -> Column:
    """A flat JSON object's text with its keys in order."""
    entries = F.array_sort(F.map_entries(F.from_json(document, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))
