"""Analytics over ordered, grouped sequences.

A sequence table has group columns, an explicit ``frame_index`` (0, 1, ...) and one or more measures; ``ordered`` makes
it from any table with a total order. Similarity of two frames is a number from 0 to 100 given as a column function.
Window and fold operators need one sequence in one task, never more; groups are spread by their keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: The share within which a measure rests, and the similarity over which a lower threshold for holds may lie.
REST, LOWEST = 0.08, 55


def _by(groups: Sequence[str]):
    return W.partitionBy(*groups).orderBy("frame_index")


def ordered(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with frame_index: each row's place in its group. The order needs a final tie-break; equal rows tie freely."""
    return df.withColumn("frame_index", F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1)


def deltas(seq: DataFrame, groups: Sequence[str], measure: str) -> DataFrame:
    """Differences of a measure to the sequence's first frame and to the frame before (null for the first)."""
    by = _by(groups)
    return seq.withColumn("first_delta", F.col(measure) - F.first(measure).over(by)).withColumn("step_delta", F.col(measure) - F.lag(measure).over(by))


def at_rest(now: Column, rest: Column, tolerance: float = REST, floor: float = 1.0) -> Column:
    """Within a share of the larger magnitude of two measures, or within the floor."""
    return F.abs(now - rest) <= F.greatest(F.lit(floor), F.greatest(F.abs(now), F.abs(rest)) * tolerance)


def motion_window(seq: DataFrame, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """First and last frame of each sequence's motion, and its activity (sum of absolute steps of all measures).

    The opening frame is the rest pose. Motion starts at the first frame that differs from it; it ends at the last such
    frame if the sequence returns to rest, else with the sequence. A sequence that never moves is all window.
    """
    by = _by(groups)
    rest = None
    step = F.lit(0)
    for m in measures:
        same = at_rest(F.col(m), F.first(m).over(by))
        rest = same if rest is None else rest & same
        step = step + F.coalesce(F.abs(F.col(m) - F.lag(m).over(by)), F.lit(0))
    marked = seq.select(*groups, "frame_index", rest.alias("rest"), step.alias("step"))
    moved = F.min(F.when(~F.col("rest"), F.col("frame_index")))
    last_moved = F.max(F.when(~F.col("rest"), F.col("frame_index")))
    last = F.max("frame_index")
    back = F.max_by("rest", "frame_index")
    return marked.groupBy(*groups).agg(
        F.coalesce(moved, F.lit(0)).cast("long").alias("start_frame"),
        F.when(moved.isNull() | ~back, last).otherwise(last_moved).cast("long").alias("end_frame"),
        F.sum("step").alias("activity"),
    )


def visual_scales(seq: DataFrame, groups: Sequence[str], height: str, target: float, zoom: float = 1.12, equalize: bool = False) -> DataFrame:
    """Scale that brings frames to a target height, in thousandths (halves up): one for the group, from its median;
    own ones for frames that the zoom ratio makes too small, or for all when equalising."""
    h = F.greatest(F.lit(1.0), F.coalesce(F.col(height).cast("double"), F.lit(1.0)))
    native = F.median(h).over(W.partitionBy(*groups))
    thousandths = lambda x: F.floor(F.lit(target) * 1000 / x + 0.5).cast("long")
    small = F.lit(True) if equalize else h * zoom < native
    return seq.select(
        *groups,
        "frame_index",
        h.alias("body_height"),
        F.when(small, thousandths(h)).otherwise(thousandths(native)).alias("scale_milli"),
        F.when(small, "equalize" if equalize else "zoom").otherwise("group").alias("reason"),
    )


def closeness(scale: float = 1.0) -> Callable[[Column, Column], Column]:
    """Similarity of two numbers: 100 less their scaled distance, no less than 0."""
    return lambda a, b: F.greatest(F.lit(0.0), 100 - F.abs(a - b) * scale)


def _sequence(seq: DataFrame, groups: Sequence[str], measure: str) -> DataFrame:
    """Each group's measures as one array in frame order."""
    return seq.groupBy(*groups).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", F.col(measure).alias("m")))), lambda x: x["m"]).alias("m"))


def _holds(m: Column, sim, threshold: Column, least: int = 3) -> Column:
    """Structs (index, anchor) of the frames that repeat both their predecessor and the last frame that was kept."""
    none = F.array().cast("array<struct<index:int,anchor:int>>")

    def step(acc: Column, i: Column) -> Column:
        now = F.element_at(m, i + 1)
        held = (sim(F.element_at(m, i), now) >= threshold) & (sim(F.element_at(m, acc["anchor"] + 1), now) >= threshold)
        found = F.concat(acc["found"], F.array(F.struct(i.alias("index"), acc["anchor"].alias("anchor"))))
        return F.struct(F.when(held, acc["anchor"]).otherwise(i).alias("anchor"), F.when(held, found).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("anchor"), none.alias("found"))
    return F.when(F.size(m) >= least, F.aggregate(F.sequence(F.lit(1), F.size(m) - 1), start, step, lambda acc: acc["found"])).otherwise(none)


def duplicate_holds(seq: DataFrame, groups: Sequence[str], measure: str, threshold: float = 88.0, sim=None, suggest: bool = False) -> DataFrame:
    """Frames to drop as repeats: similar both to the frame before and to the last kept frame (its anchor).

    A frame unlike the one before is never dropped and becomes the anchor, so sequences are cut there first, and a fold
    goes over one stretch of neighbouring likes, not over a sequence.

    suggest: where nothing matches, try the floor of the strongest similarity of neighbours if that lies over 55 and
    under the threshold, unless its matches are an even stride over half of the sequence; a sequence is one array then.
    """
    sim = sim or closeness()
    level = F.lit(float(threshold))
    if not suggest:
        by = _by(groups)
        like = sim(F.lag(measure).over(by), F.col(measure)) >= level
        cut = seq.withColumn("_cut", F.coalesce(~like, F.lit(False)).cast("int")).withColumn("_n", F.count("*").over(W.partitionBy(*groups)))
        cut = cut.where("_n >= 3").withColumn("_stretch", F.sum("_cut").over(by))
        stretch = cut.groupBy(*groups, "_stretch").agg(F.array_sort(F.collect_list(F.struct("frame_index", F.col(measure).alias("m")))).alias("f")).where(F.size("f") > 1)
        held = _bound(F.transform("f", lambda x: x["m"]), lambda m: _holds(m, sim, level, 2))
        out = stretch.select(*groups, "f", level.alias("threshold"), F.explode(held).alias("x"))
        place = lambda c: F.get("f", F.col(f"x.{c}"))["frame_index"].cast("long")
        return out.select(*groups, place("index").alias("frame_index"), place("anchor").alias("match_index"), "threshold")
    m = F.col("m")
    found = lambda at: F.struct(_holds(m, sim, at).alias("found"), at.alias("threshold"))
    chosen = found(level)
    n = F.size(m)
    near = F.zip_with(F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), sim)
    tried = F.struct(chosen.alias("first"), F.floor(F.array_max(near)).cast("double").alias("low"))
    chosen = _bound(tried, lambda t: F.when((F.size(t["first"]["found"]) == 0) & (t["low"] > LOWEST) & (t["low"] < level), _bound(found(t["low"]), lambda x: F.when(~_even_stride(x["found"], n), x))).otherwise(t["first"]))
    out = _sequence(seq, groups, measure).select(*groups, chosen.alias("x")).select(*groups, "x.threshold", F.explode("x.found").alias("x"))
    return out.select(*groups, F.col("x.index").cast("long").alias("frame_index"), F.col("x.anchor").cast("long").alias("match_index"), "threshold")


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once however often f uses it."""
    return F.transform(F.array(x), f)[0]


def _even_stride(found: Column, n: Column) -> Column:
    """Whether the found frames stand evenly and are half of a sequence of n, so that it is motion, not holds."""
    k = F.size(found)
    index = F.transform(found, lambda x: x["index"])
    gaps = F.zip_with(F.slice(index, F.lit(2), F.greatest(k - 1, F.lit(0))), F.slice(index, F.lit(1), F.greatest(k - 1, F.lit(0))), lambda a, b: a - b)
    return (k >= 3) & (n >= 4) & (k >= F.floor((n - 1) / 2)) & (F.size(F.array_distinct(gaps)) == 1)


def jump_frames(seq: DataFrame, groups: Sequence[str], measure: str, threshold: float = 88.0, sim=None, suggest: bool = False) -> DataFrame:
    """Frames unlike both neighbours while these resemble each other: the bridge's similarity less the weaker side's.

    suggest: where a sequence has no such frame at the threshold, the least whole threshold at which its strongest score
    counts is taken, if that is higher and at most 100; the threshold of each row is a column then. The strongest score
    is a window over the same sequence, so that nothing more is shuffled.
    """
    sim = sim or closeness()
    by = _by(groups)
    before, after, now = F.lag(measure).over(by), F.lead(measure).over(by), F.col(measure)
    three = seq.select(*groups, "frame_index", before.alias("b"), now.alias("n"), after.alias("a")).where("b IS NOT NULL AND a IS NOT NULL")
    score = sim(F.col("b"), F.col("a")) - F.least(sim(F.col("b"), F.col("n")), sim(F.col("n"), F.col("a")))
    scored = three.select(*groups, "frame_index", score.alias("score")).where("score > 0")
    if not suggest:
        return scored.where(F.col("score") >= 100 - threshold)
    raised = F.ceil(100 - F.max("score").over(W.partitionBy(*groups))).cast("double")
    chosen = F.when((raised > threshold) & (raised <= 100), raised).otherwise(float(threshold))
    return scored.withColumn("threshold", chosen).where(F.col("score") >= 100 - F.col("threshold"))


def pair_similarity(seq: DataFrame, groups: Sequence[str], measure: str, max_lag: int, sim=None) -> DataFrame:
    """Similarity of all pairs of frames at most max_lag apart: a band, so each frame meets a bounded number of others.

    Each frame is sent to the bucket of its place and to the next, and pairs meet within a bucket: no task holds a
    whole sequence, however long.
    """
    sim = sim or closeness()
    bucket = F.floor(F.col("frame_index") / max_lag)
    left = seq.select(*groups, bucket.alias("bucket"), F.col("frame_index").alias("i"), F.col(measure).alias("x"))
    right = seq.select(*groups, F.explode(F.array(bucket, bucket - 1)).alias("bucket"), F.col("frame_index").alias("j"), F.col(measure).alias("y"))
    pairs = left.join(right, [*groups, "bucket"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= max_lag))
    return pairs.select(*groups, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), sim(F.col("x"), F.col("y")).alias("similarity"))


def autocorrelation(seq: DataFrame, groups: Sequence[str], measure: str, sim=None, units: int = 100, most: int | None = None, tile: int = 256) -> DataFrame:
    """frames, and for each lag (period) up to ``most``, by default two thirds of the sequence's frames, the number of
    pairs of frames so far apart and their summed similarity in whole parts of 1 / units, so that sums are exact.

    Frames meet in square tiles of their places and are summed there before they are shuffled again: the work is that
    of all pairs, as asked, but no pair is written and no task holds more than some tiles, however long a sequence is.
    """
    sim = sim or closeness()
    n = seq.groupBy(*groups).agg(F.count("*").alias("frames"))
    lags = F.least(F.col("frames") - 1, F.floor(F.col("frames") * 2 / 3) if most is None else F.lit(most))
    s = seq.select(*groups, "frame_index", F.col(measure).alias("m")).join(n.where("frames > 1").withColumn("lags", lags).where("lags > 0"), list(groups))
    at = lambda place: F.floor(place / tile)
    i = F.col("frame_index")
    left = s.select(*groups, "frames", "lags", i.alias("i"), F.col("m").alias("x"), at(i).alias("row"), F.explode(F.sequence(at(i), at(F.least(i + F.col("lags"), F.col("frames") - 1)))).alias("col"))
    right = s.select(*groups, i.alias("j"), F.col("m").alias("y"), F.explode(F.sequence(at(F.greatest(i - F.col("lags"), F.lit(0))), at(i))).alias("row"), at(i).alias("col"))
    pairs = left.join(right, [*groups, "row", "col"]).where((F.col("i") < F.col("j")) & (F.col("j") - F.col("i") <= F.col("lags")))
    return pairs.groupBy(*groups, "frames", (F.col("j") - F.col("i")).cast("long").alias("period")).agg(
        F.sum(F.floor(sim(F.col("x"), F.col("y")) * units + 0.5).cast("long")).alias("similarity_sum"), F.count("*").alias("n")
    )


def arrival(seq: DataFrame, groups: Sequence[str], duration: Column, phase: Column | float = 0.5) -> DataFrame:
    """When each frame's phase is reached: the durations of earlier frames and its own times the phase."""
    phase = phase if isinstance(phase, Column) else F.lit(phase)
    earlier = F.coalesce(F.sum(duration).over(_by(groups).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return seq.withColumn("starts_at", earlier).withColumn("arrives_at", earlier + duration * phase)


def temporal_stability(seq: DataFrame, groups: Sequence[str], centre: str, area: str) -> DataFrame:
    """Number of frames, and mean absolute deviations of centre and area from their means.

    In millionths from integer sums over n, so that no float sum depends on row order: |n x - sum| summed, over n squared.
    """
    g = W.partitionBy(*groups)
    dev = lambda c: F.abs(F.col(c) * F.count("*").over(g) - F.sum(c).over(g))
    drift = seq.select(*groups, dev(centre).alias("dc"), dev(area).alias("da"))
    out = lambda c: F.floor(F.sum(c) * 1000000 / (F.count("*") * F.count("*"))).cast("long")
    return drift.groupBy(*groups).agg(F.count("*").alias("frames"), out("dc").alias("centre_drift_micro"), out("da").alias("area_drift_micro"))


def active_range(seq: DataFrame, groups: Sequence[str], score: str, share: float = 0.12) -> DataFrame:
    """First and last frame whose score reaches a share of the sequence's peak."""
    peak = F.max(score).over(W.partitionBy(*groups))
    live = seq.select(*groups, "frame_index", F.col(score).alias("s"), peak.alias("peak")).where(F.col("s") >= F.col("peak") * share)
    return live.groupBy(*groups).agg(F.min("frame_index").cast("long").alias("start_frame"), F.max("frame_index").cast("long").alias("end_frame"), F.count("*").alias("active"))


def trimmed_span(seq: DataFrame, groups: Sequence[str], mass: str, trim: float = 0.003) -> DataFrame:
    """First and last position once a share of the mass is dropped from either end."""
    g = W.partitionBy(*groups)
    up = F.sum(mass).over(_by(groups).rowsBetween(W.unboundedPreceding, 0))
    down = F.sum(mass).over(g.orderBy(F.desc("frame_index")).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(mass).over(g)
    run = seq.select(*groups, "frame_index", up.alias("up"), down.alias("down"), total.alias("total"))
    return run.groupBy(*groups).agg(
        F.min(F.when(F.col("up") > F.col("total") * trim, F.col("frame_index"))).cast("long").alias("start_pos"),
        F.max(F.when(F.col("down") > F.col("total") * trim, F.col("frame_index"))).cast("long").alias("end_pos"),
    )


def dense_runs(seq: DataFrame, groups: Sequence[str], mass: str, floor: float = 4.0, share: float = 0.22, gap: int = 6) -> DataFrame:
    """Runs of positions whose five-wide centred sum reaches the threshold, over gaps of at most ``gap`` positions.

    The threshold is the larger of floor and a share of the highest mean, both times five, so sums stay exact.
    Returns each group's heaviest run, the earlier one of equals.
    """
    by, g = _by(groups), W.partitionBy(*groups)
    near = F.sum(mass).over(by.rowsBetween(-2, 2))
    smooth = seq.select(*groups, "frame_index", F.col(mass).alias("mass"), near.alias("near"))
    dense = smooth.withColumn("top", F.max("near").over(g)).where(F.col("near") >= F.greatest(F.lit(floor) * 5, F.col("top") * share))
    new = (F.col("frame_index") - F.lag("frame_index").over(by) > gap + 1).cast("int")
    runs = dense.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(by))
    runs = runs.groupBy(*groups, "run").agg(F.min("frame_index").alias("start_pos"), F.max("frame_index").alias("end_pos"), F.sum("mass").alias("run_mass"))
    best = F.row_number().over(W.partitionBy(*groups).orderBy(F.desc("run_mass"), "start_pos"))
    return runs.withColumn("r", best).where("r = 1").select(*groups, F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), "run_mass")


def even_samples(groups_df: DataFrame, length: str, count: int) -> DataFrame:
    """``count`` places spread evenly over 0 .. length - 1, halves up; fewer when the sequence is shorter."""
    k = F.least(F.col(length), F.lit(count))
    places = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.when(k > 1, F.floor(i * (F.col(length) - 1) / (k - 1) + 0.5)).otherwise(0))
    return groups_df.withColumn("frame_index", F.explode(F.when(k > 0, F.array_distinct(places)))).withColumn("frame_index", F.col("frame_index").cast("long"))


def spread_places(start: Column, end: Column, count: Column) -> Column:
    """``count`` places spread evenly from start to end (inclusive), halves up: the middle for one; where there are fewer
    places than asked, some are repeated; none where the range or the count is empty."""
    start, end, count = (c.cast("long") for c in (start, end, count))
    at = lambda i: F.floor(start + i * (end - start) / F.greatest(count - 1, F.lit(1)) + 0.5)
    many = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1), at)
    none = F.array().cast("array<bigint>")
    return F.when((count < 1) | (end < start) | (start < 0), none).when(count == 1, F.array(F.floor((start + end) / 2 + 0.5))).otherwise(many)
