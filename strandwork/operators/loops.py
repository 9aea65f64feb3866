"""Loop search over mean similarities by lag."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.operators.sequences import autocorrelation, closeness


#: How near two periods count as one, the least share of a period's score that a start must reach, how
#: much a preference for short or long loops weighs, and the number of candidates.
NEAR, FACTOR, PREFERENCE, TOP = 2, 0.85, 0.3, 6


def lower_hull(values: np.ndarray) -> np.ndarray:
    """The lower convex hull of values at 0, 1, ..., read at each place in single precision."""
    hull: list[int] = []
    for x in range(len(values)):
        while len(hull) > 1 and (hull[-1] - hull[-2]) * (values[x] - values[hull[-2]]) <= (x - hull[-2]) * (values[hull[-1]] - values[hull[-2]]):
            hull.pop()
        hull.append(x)
    return np.interp(np.arange(len(values)), hull, values[hull]).astype(np.float32).astype(np.float64)


def peaks(acf: np.ndarray) -> list[int]:
    """Places over the hull that are local maxima of the ratio to it, the highest first; ties in order of place."""
    base = lower_hull(acf)
    side = np.concatenate([[-np.inf], acf / np.maximum(base, np.finfo(float).eps), [-np.inf]])
    ratio = np.where(base > 0, side[1:-1], 0)
    at = np.flatnonzero((ratio > 1) & (ratio >= side[:-2]) & (ratio >= side[2:]))
    return at[np.argsort(-acf[at], kind="stable")].tolist()


def apart(places: list[int]) -> list[int]:
    """The places that are not near one chosen before."""
    chosen: list[int] = []
    for p in places:
        if all(abs(p - q) > NEAR for q in chosen):
            chosen.append(p)
    return chosen


@F.pandas_udf(T.ArrayType(T.LongType()))
def _chosen(acf: pd.Series) -> pd.Series:
    return acf.map(lambda x: apart(peaks(np.asarray(x, np.float64))))


def loop_candidates(seq: DataFrame, groups: Sequence[str], measure: str, scale: float = 1.0, least: int = 2, most: int | None = None, prefer: str = "auto", top: int = TOP, sim: Callable[[Column, Column], Column] | None = None, lags: DataFrame | None = None) -> DataFrame:
    """Loop candidates of each sequence of a numeric measure (similarity: 100 less the scaled distance), best first.

    groups, rank (from 1), start_frame, period, score, smoothness, coverage, rank_score. Mean similarities by lag come
    from ``autocorrelation``; only they, two thirds as many numbers as a sequence has frames, are gathered to find their
    peaks over the hull. Each chosen period then sets every frame against the one a period on, in a join on the place.
    Sequences of fewer than four frames have none. sim: another similarity of two measures; lags: its sums by lag if they
    are known, as ``likeness.pair_similarities`` gives them in millionths for frames.
    """
    sim = sim or closeness(scale)
    lags = autocorrelation(seq, groups, measure, sim, 1_000_000, most) if lags is None else lags
    lags = lags.where((F.col("period") >= least) & (F.col("frames") >= 4))
    lags = lags.withColumn("acf", (F.col("similarity_sum") / (F.col("n") * 1e8)).cast("float").cast("double"))
    curves = lags.groupBy(*groups, "frames").agg(F.array_sort(F.collect_list(F.struct("period", "acf"))).alias("curve"), F.max("period").alias("last"))
    places = curves.withColumn("at", F.explode(_chosen(F.transform("curve", lambda x: x["acf"]))))
    periods = places.select(*groups, "frames", "last", (F.col("at") + least).alias("period"), F.element_at("curve", (F.col("at") + 1).cast("int"))["acf"].alias("acf"))

    frames = seq.select(*groups, F.col("frame_index").alias("i"), F.col(measure).alias("x"))
    before = F.lag(measure).over(W.partitionBy(*groups).orderBy("frame_index"))
    ends = seq.select(*groups, F.col("frame_index").alias("end"), F.col(measure).alias("y"), before.alias("z"))
    share = lambda a, b: sim(a, b).cast("float").cast("double") / 100
    starts = (
        frames.join(periods, list(groups))
        .where(F.col("i") + F.col("period") < F.col("frames"))
        .withColumn("end", F.col("i") + F.col("period"))
        .join(ends, [*groups, "end"])
        .where(share(F.col("x"), F.col("y")) >= F.col("acf") * FACTOR)
    )
    best = F.max(F.struct(share(F.col("x"), F.col("z")).alias("seam"), (-F.col("i")).alias("i"))).alias("best")
    found = starts.groupBy(*groups, "frames", "last", "period", "acf").agg(F.count("*").alias("n"), best).where(F.col("n") >= F.col("period") / 2)
    place = (F.col("period") - least) / F.greatest(F.lit(1), F.col("last") - least)
    weight = {"short": 1 - place * PREFERENCE, "long": place * PREFERENCE + (1 - PREFERENCE)}.get(prefer, F.lit(1.0))
    score = F.col("acf") * F.col("best.seam")
    out = found.withColumn("rank_score", score * weight)
    first = F.row_number().over(W.partitionBy(*groups).orderBy(F.desc("rank_score"), F.desc("acf"), "period"))
    return (
        out.withColumn("rank", first)
        .where(F.col("rank") <= top)
        .select(*groups, "rank", (-F.col("best.i")).cast("long").alias("start_frame"), F.col("period").cast("long").alias("period"), score.alias("score"), F.col("best.seam").alias("smoothness"), (F.col("period") / F.col("frames")).alias("coverage"), "rank_score")
    )


def one_shot_likely(frames: Column, coverage: Column, length: Column, period: Column, smoothness: Column, similarity: Column, score: Column) -> Column:
    """Whether a clip's best loop looks like a burst: under half of it and under 12 frames, unless a solid cycle."""
    low = coverage.isNull() | (coverage < 0.5)
    solid = (period == length) & (length >= 12) & (F.coalesce(smoothness >= 0.7, F.lit(False)) | F.coalesce(similarity >= 70, F.lit(False)) | F.coalesce(score >= 0.45, F.lit(False)))
    return F.when(score.isNull(), True).when((frames < 12) | F.coalesce(solid, F.lit(False)), False).otherwise(low & (length.isNull() | (length < 12)))
