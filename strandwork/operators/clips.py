"""Clips and what is bound to their frames: trails of sticks, attachments, boxes, imports, audits and quality issues.

Joins are on keys; a frame's sticks and attachments are ordered within the frame or clip that they belong to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.medians import ranked_columns

#: Names of attacking and of upright clips, of clips that fire, and what marks a clip as not upright.
ATTACKS = ("attack", "atk", "slash", "strike", "shoot", "shot", "fire", "skill", "cast", "stab", "punch", "kick", "bite", "claw", "parry", "counter")
ATTACKS_ZH = ("攻击", "攻擊", "斩", "斬", "劈", "刺", "射击", "射擊", "技能", "格挡", "格擋", "招架", "反击", "反擊", "砍")
UPRIGHT = ("idle", "stand", "walk", "run")
NOT_UPRIGHT = ("attack", "atk", "slash", "strike", "slide", "dash", "jump", "air", "fall", "hurt", "death", "crouch", "roll")
FIRING = ("shoot", "shot", "fire", "cast", "projectile", "skill")
#: Least step between the phases of sticks on a frame; span of a clip in which a hit counts; clips' samples.
PHASE_STEP, HIT_FROM, HIT_TO, SAMPLES = 0.0001, 0.25, 0.85, 4


def looks_attack(name: Column) -> Column:
    low = F.lower(name)
    return low.rlike(rf"(^|[\s_-])({'|'.join(ATTACKS)})($|[\s_-]|\d)") | low.rlike("|".join(ATTACKS_ZH))


def looks_upright(name: Column) -> Column:
    low = F.lower(name)
    return ~low.rlike("|".join(NOT_UPRIGHT)) & low.rlike("|".join(UPRIGHT))


def hit_enabled(frame: Column, frames: Column, name: Column) -> Column:
    """Whether a frame's hit box is on by default: firing clips and clips of three frames throughout, else mid-clip."""
    inside = ((frame + 1) / frames >= HIT_FROM) & (frame / frames <= HIT_TO)
    return F.lower(name).rlike("|".join(FIRING)) | (frames <= 3) | inside


def valid_box(width: Column, height: Column, *offsets: Column) -> Column:
    """A box of positive size and finite offsets."""
    finite = [c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")) for c in offsets]
    ok = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    for c in finite:
        ok = ok & c
    return ok


def strict_selection(frames: DataFrame, groups: Sequence[str], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted frames (groups, frame_index), and the reasons why requests are refused: duplicate, or out of range."""
    asked = wanted.groupBy(*groups, "frame_index").agg(F.count("*").alias("times"))
    found = asked.join(frames.select(*groups, "frame_index", F.lit(True).alias("there")), [*groups, "frame_index"], "left")
    reason = F.when(F.col("there").isNull(), "out of range").when(F.col("times") > 1, "duplicate")
    return frames.join(wanted.select(*groups, "frame_index").distinct(), [*groups, "frame_index"], "left_semi"), found.select(*groups, "frame_index", reason.alias("reason")).where("reason IS NOT NULL")


def travel(sticks: DataFrame, clips: Sequence[str]) -> DataFrame:
    """sticks: clips, order, top_x, top_y, bottom_x, bottom_y -> how far the centres move from stick to stick, and the
    faster ends do; in thousandths, each step rounded, so that sums don't depend on their order."""
    by = W.partitionBy(*clips).orderBy("order")
    move = lambda x, y: F.hypot((x - F.lag(x).over(by)).cast("double"), (y - F.lag(y).over(by)).cast("double"))
    tx, ty, bx, by_ = (F.col(c) for c in ("top_x", "top_y", "bottom_x", "bottom_y"))
    whole = lambda v: F.floor(v * 1000 + 0.5).cast("long")
    steps = sticks.select(*clips, whole(move((tx + bx) / 2, (ty + by_) / 2)).alias("c"), whole(F.greatest(move(tx, ty), move(bx, by_))).alias("e"))
    return steps.groupBy(*clips).agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("centre_milli"), F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("edge_milli"))


def spread_phases(sticks: DataFrame, frames: Sequence[str]) -> DataFrame:
    """sticks: frames (clip and frame), order, manual, phase -> phase: automatic ones lie evenly between the manual ones
    around them (0 and 1 at the ends), then all are raised to rise by at least PHASE_STEP and stay under 1.

    Raising each to its predecessor's plus the step is a running maximum of the phases less their steps. Rows are sorted
    twice, once from the end and once from the start; equal places are told apart by what sticks are, so that both agree.
    """
    place, ties = W.partitionBy(*frames), ["order", "manual", "phase"]
    start, end = place.orderBy(*ties), place.orderBy(*[F.desc(c) for c in ties])
    earlier = (W.unboundedPreceding, -1)
    fixed, at = F.when(F.col("manual"), F.col("phase")), lambda c: F.when(F.col("manual"), F.col(c))
    s = sticks.withColumn("_r", F.row_number().over(end)).withColumn("n", F.count("*").over(place)).withColumn("high", F.coalesce(F.last(fixed, True).over(end.rowsBetween(*earlier)), F.lit(1.0)))
    s = s.withColumn("high_i", F.col("n") - F.coalesce(F.last(at("_r"), True).over(end.rowsBetween(*earlier)), F.lit(0))).drop("_r")
    s = s.withColumn("i", F.row_number().over(start).cast("long") - 1)
    s = s.withColumn("low", F.coalesce(F.last(fixed, True).over(start.rowsBetween(*earlier)), F.lit(0.0))).withColumn("low_i", F.coalesce(F.last(at("i"), True).over(start.rowsBetween(*earlier)), F.lit(-1)))
    even = F.col("low") + (F.col("high") - F.col("low")) * (F.col("i") - F.col("low_i")) / (F.col("high_i") - F.col("low_i"))
    s = s.withColumn("p", F.when(F.col("manual"), F.col("phase")).otherwise(even))
    raised = F.max(F.col("p") - F.col("i") * PHASE_STEP).over(start.rowsBetween(W.unboundedPreceding, 0))
    final = F.col("i") * PHASE_STEP + F.least(1 - (F.col("n") - 1) * PHASE_STEP, F.greatest(F.lit(0.0), raised))
    return s.withColumn("phase", final).drop("i", "n", "low", "low_i", "high", "high_i", "p")


def remap_sticks(sticks: DataFrame, order: DataFrame, clips: Sequence[str], segment: str) -> DataFrame:
    """sticks (clips, segment, source_index, frame, phase, order) under a new frame order (clips, new_index, source_index).

    A stick repeats for each new place of its frame; sticks are then ordered by place, phase (none: the middle), saved
    order (none: their place in the file) and place in the file.
    """
    plan = order.where("source_index IS NOT NULL").select(*clips, F.col("source_index").alias("frame"), F.col("new_index").cast("long").alias("new_frame"))
    phase = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("phase"))), F.lit(0.5))
    placed = sticks.join(plan, [*clips, "frame"])
    by = W.partitionBy(*clips, segment).orderBy("new_frame", phase, F.coalesce("order", "source_index"), "source_index")
    return placed.withColumn("order", F.row_number().over(by).cast("long") - 1).withColumn("frame", F.col("new_frame")).drop("new_frame")


def attachments_of(frames: DataFrame, attachments: DataFrame) -> DataFrame:
    """frames (binding, animation, frame) with their attachments (attachment_id, key, meta_animation, meta_frame).

    One matches by its key ``binding:frame``, or by its frame if it names no clip or this one; a key's own frame goes
    before the metadata's. Attachments that name a clip join on it and the frame; only those that name none join on frames
    alone, as their rule says.
    """
    key = F.col("key")
    parts = F.split(key, ":")
    long = F.size(parts) >= 7
    tail = F.expr("try_cast(element_at(split(key, ':'), -1) AS bigint)")
    left = F.regexp_extract(key, r"^(.*):[^:]*$", 1)
    short = F.when(left.contains("/"), F.regexp_extract(left, r"^[^/]*/(.*)$", 1)).otherwise(left)
    named = F.when(long, F.get(parts, F.lit(4))).when(key.contains(":"), short).otherwise("")
    a = attachments.withColumn("_named", F.when(tail.isNotNull(), named).otherwise("")).withColumn("_frame", F.coalesce(tail, F.col("meta_frame").cast("long")))
    a = a.withColumn("_clip", F.coalesce(F.when(F.col("meta_animation") != "", F.col("meta_animation")), F.col("_named"), F.lit("")))
    f = frames.select("binding", "animation", F.col("frame").cast("long").alias("frame")).distinct()
    rules = a.select("attachment_id", "key", "_named", "_frame", "_clip").distinct().withColumn("_rules", F.count("*").over(W.partitionBy("attachment_id")))
    return _attached(f, rules.where("_rules = 1")).union(_attached(f, rules.where("_rules > 1")).distinct())


def _attached(f: DataFrame, a: DataFrame) -> DataFrame:
    """Each frame with each attachment that matches it: the ways to match exclude each other, so a row of attachments
    brings a frame once, and nothing has to be told apart in the result."""
    out = ["binding", "animation", "frame", "attachment_id"]
    of_clip = (F.col("_clip") == F.col("animation")) | (F.col("_named") == F.col("animation"))
    otherwise = F.coalesce((F.col("_frame") == F.col("frame")) & ((F.col("_clip") == "") | of_clip | (F.col("_clip") == F.col("binding"))), F.lit(False))
    by_key = f.withColumn("key", F.concat_ws(":", "binding", F.col("frame").cast("string"))).join(a, "key").where(~otherwise).select(*out)
    clips = a.where("_clip <> ''").select("attachment_id", F.col("_frame").alias("frame"), "_clip", "_named")
    by_clip = f.join(clips.withColumn("animation", F.explode(F.array_distinct(F.array("_clip", "_named")))), ["frame", "animation"]).select(*out)
    by_binding = f.join(clips.withColumn("binding", F.col("_clip")), ["frame", "binding"]).where(~F.coalesce(of_clip, F.lit(False))).select(*out)
    anywhere = f.join(a.where("_clip = ''").select("attachment_id", F.col("_frame").alias("frame")), "frame")
    return by_key.union(by_clip).union(by_binding).union(anywhere.select(*out))


def source_height(samples: DataFrame, groups: Sequence[str], clip: str, name: str, height: str, order: Sequence[str], least: float = 16) -> DataFrame:
    """A group's figure height: the middle height of at most four samples a clip, of upright clips where there are any."""
    first = F.row_number().over(W.partitionBy(*groups, clip).orderBy(*order))
    some = samples.withColumn("_r", first).where(F.col("_r") <= SAMPLES).where(F.col(height) >= least)
    some = some.withColumn("_up", looks_upright(F.col(name)))
    some = some.withColumn("_any", F.max("_up").over(W.partitionBy(*groups))).where("_up OR NOT _any")
    by = W.partitionBy(*groups).orderBy(height, *order)
    ranked = some.withColumn("_i", F.row_number().over(by) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*groups)))
    return ranked.where(F.col("_i") == F.floor((F.col("_n") - 1) * 0.5 + 0.5)).select(*groups, F.col(height).alias("source_height"), F.col("_n").alias("samples"))


def binding_audit(trails: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bindings that stand on one side only or differ in number: trails and manifest are keys and n."""
    both = trails.select(*keys, F.col("n").alias("n_trails")).join(manifest.select(*keys, F.col("n").alias("n_manifest")), list(keys), "full_outer")
    kind = F.when(F.col("n_manifest").isNull(), "unexpected").when(F.col("n_trails").isNull(), "missing").when(F.col("n_trails") != F.col("n_manifest"), "count mismatch")
    return both.withColumn("issue", kind).where("issue IS NOT NULL")


def import_clips(there: DataFrame, new: DataFrame, groups: Sequence[str], name: str, replace: bool = False) -> DataFrame:
    """there and new: groups, name and other columns alike. Replacing, a new clip goes before one of its name; else it
    gets the least free ``_2``, ``_3`` ... Names of new clips are distinct within a group."""
    keys = [*groups, name]
    if replace:
        return there.join(new.select(*keys), keys, "left_anti").unionByName(new)
    taken = there.select(*keys).distinct()
    clash = new.join(taken.withColumn("_taken", F.lit(True)), keys, "left")
    # suffixes in use, of old and new names alike, by the name that they follow
    used = taken.unionByName(new.select(*keys))
    stem, digits = F.regexp_extract(F.col(name), r"^(.*)_(\d+)$", 1), F.expr(f"try_cast(regexp_extract(`{name}`, '^(.*)_([0-9]+)$', 2) AS bigint)")
    used = used.select(*groups, stem.alias(name), digits.alias("_k")).where("_k >= 2").groupBy(*keys).agg(F.sort_array(F.collect_set("_k")).alias("_used"))
    clash = clash.join(used, keys, "left")
    u = F.coalesce("_used", F.array().cast("array<bigint>"))
    free = F.aggregate(u, F.lit(2).cast("bigint"), lambda acc, k: F.when(k == acc, acc + 1).otherwise(acc))
    return there.unionByName(clash.withColumn(name, F.when(F.col("_taken"), F.concat(name, F.lit("_"), free.cast("string"))).otherwise(F.col(name))).drop("_taken", "_used"))


def remove_bindings(bindings: DataFrame, gone: DataFrame, keys: Sequence[str], groups: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The bindings that stay, and how many go and stay in each group."""
    marked = bindings.join(gone.select(*keys).distinct().withColumn("_gone", F.lit(True)), list(keys), "left")
    count = marked.groupBy(*groups).agg(F.count("_gone").alias("removed"), (F.count("*") - F.count("_gone")).alias("kept"))
    return marked.where("_gone IS NULL").drop("_gone"), count


def size_totals(files: DataFrame, groups: Sequence[str], before: str, after: str) -> DataFrame:
    """Bytes before and after, and those saved; files that grew keep their old size."""
    kept = F.least(F.col(before), F.col(after))
    return files.groupBy(*groups).agg(F.count("*").alias("files"), F.sum(before).cast("long").alias("bytes_before"), F.sum(kept).cast("long").alias("bytes_after"), F.sum(F.col(before) - kept).cast("long").alias("bytes_saved"))


def quality_issues(measured: DataFrame, groups: Sequence[str], size: float = 0.2, feet: float = 3, centre: float = 5, holes: int = 4, edge: float = 0.25) -> DataFrame:
    """measured: groups, frame_index, box_height, body_height, feet, centre, hole_pixels, white_edge, edge_pixels,
    boundary -> issues: an array of the kinds that a frame is flagged for, in the order in which they are looked for.

    References are a clip's upper medians of body height, feet and centre.
    """
    middle = {f"_{c}": (c, lambda n: F.floor(n / 2)) for c in ("body_height", "feet", "centre")}
    out = measured.join(ranked_columns(measured, groups, middle), list(groups), "left")
    apart = lambda c: F.abs(F.col(c) - F.col(f"_{c}"))
    kinds = [
        ("empty", F.col("box_height") == 0),
        ("size_jump", (F.col("_body_height") > 0) & (apart("body_height") / F.col("_body_height") > size)),
        ("feet_drift", apart("feet") > feet),
        ("center_drift", apart("centre") > centre),
        ("alpha_holes", F.col("hole_pixels") >= holes),
        ("bright_edge", (F.col("white_edge") >= 4) & (F.col("white_edge") / F.greatest(F.col("edge_pixels"), F.lit(1)) > edge)),
        ("touches_canvas_edge", F.col("boundary") > 0),
    ]
    return out.withColumn("issues", F.array_compact(F.array(*[F.when(c, k) for k, c in kinds]))).drop("_body_height", "_feet", "_centre")
