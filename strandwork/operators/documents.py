"""Relational maintenance of sequence documents: reorder, merge, split, rename, strip, upsert, compare, retain, check.

Every operator is a join, anti-join or union on key columns; nothing is gathered on the driver. Ties are broken by
explicit keys, so results don't depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reorganize(bindings: DataFrame, order: DataFrame, groups: Sequence[str], frame: str = "frame_index") -> DataFrame:
    """Bindings moved to a new order: order has groups, new_index and old_index, with repeats and omissions at will.

    A frame that the order repeats takes its bindings to each new place; one that it omits loses them. Groups without
    an order stay as they are.
    """
    moved = order.join(bindings.withColumnRenamed(frame, "old_index"), [*groups, "old_index"]).withColumn(frame, F.col("new_index")).drop("old_index", "new_index")
    rest = bindings.join(order.select(*groups).distinct(), list(groups), "left_anti")
    return moved.select(bindings.columns).union(rest)


def reference_remap(references: DataFrame, order: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """A referenced frame's first new place, or null if the order omits it."""
    first = order.groupBy(*groups, F.col("old_index").alias(column)).agg(F.min("new_index").alias("new_reference"))
    return references.join(first, [*groups, column], "left")


def merge_sequences(seq: DataFrame, members: DataFrame, key: str, fps: Column | None = None) -> DataFrame:
    """Sequences chained into one: members has key, merged and position. frame_index gets the lengths before added.

    fps: a member's rate; durations are multiplied by the merged rate (its first member's) over the member's own.
    """
    length = seq.groupBy(key).agg((F.max("frame_index") + 1).alias("length"))
    by = W.partitionBy("merged").orderBy("position")
    m = members.join(length, key).withColumn("offset", F.coalesce(F.sum("length").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = seq.join(m, key).withColumn("frame_index", F.col("frame_index") + F.col("offset"))
    if fps is not None:
        m = m.withColumn("rate", fps)
        m = m.withColumn("stretch", F.first("rate").over(by) / F.col("rate"))
        out = seq.join(m, key).withColumn("frame_index", F.col("frame_index") + F.col("offset")).withColumn("duration", F.col("duration") * F.col("stretch"))
    return out.drop("length")


def split_sequence(seq: DataFrame, cuts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """cuts: groups, part, start, end (inclusive). Each part's frames are numbered from 0; parts may overlap.

    A cut names each of its frames, so that a frame meets only the cuts that have it.
    """
    named = cuts.select("*", F.explode(F.sequence(F.col("start").cast("long"), F.greatest("start", "end").cast("long"))).alias("frame_index")).where("start <= end")
    kind = seq.schema["frame_index"].dataType
    out = seq.join(named.withColumn("frame_index", F.col("frame_index").cast(kind)), [*groups, "frame_index"])
    place = F.col("frame_index") - F.col("start")
    return out.select(*seq.columns, *[c for c in cuts.columns if c not in groups], place.alias("_place")).withColumn("frame_index", F.col("_place")).drop("start", "end", "_place")


def strip_owned(bindings: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bindings whose owner was not deleted."""
    return bindings.join(owners.select(*keys).distinct(), list(keys), "left_anti")


def upsert(current: DataFrame, patch: DataFrame, keys: Sequence[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Patch columns replace current ones where they are not null; keys only in the patch are added.

    defaults: a row all of whose named columns hold these values is the default, and is dropped.
    """
    values = [c for c in current.columns if c not in keys]
    both = current.alias("c").join(patch.alias("p"), list(keys), "full_outer")
    out = both.select(*keys, *[F.coalesce(F.col(f"p.{v}") if v in patch.columns else F.lit(None), F.col(f"c.{v}")).alias(v) for v in values])
    if defaults:
        default = F.lit(True)
        for c, v in defaults.items():
            default = default & F.col(c).eqNullSafe(F.lit(v))
        out = out.where(~default)
    return out


def compare_revisions(left: DataFrame, right: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or changed, by the hash of their content."""
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    a, b = left.select(*keys, digest.alias("h1")), right.select(*keys, digest.alias("h2"))
    both = a.join(b, list(keys), "full_outer").where(~F.col("h1").eqNullSafe(F.col("h2")))
    return both.select(*keys, F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").otherwise("changed").alias("status"))


def prune_revisions(revisions: DataFrame, groups: Sequence[str], newest: Sequence[Column], automatic: Column, limit: int = 20) -> DataFrame:
    """Revisions that retention removes: automatic ones beyond the newest ``limit``; the latest of all is protected."""
    by = W.partitionBy(*groups).orderBy(*newest)
    marked = revisions.withColumn("latest", F.row_number().over(by) == 1).withColumn("automatic", automatic)
    nth = F.row_number().over(W.partitionBy(*groups, "automatic").orderBy(*newest))
    return marked.withColumn("nth", nth).where(F.col("automatic") & ~F.col("latest") & (F.col("nth") > limit)).drop("latest", "automatic", "nth")


def first_class(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first pattern that a text matches."""
    out = None
    for pattern, name in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def top_one(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group; the order needs a final tie-break."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where("_r = 1").drop("_r")


def modal_value(df: DataFrame, groups: Sequence[str], value: Sequence[str], seen: Column) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    n = df.groupBy(*groups, *value).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    return top_one(n, groups, [F.desc("n"), F.col("first_seen")])


def dominant_value(df: DataFrame, groups: Sequence[str], channels: Sequence[str], seen: Column, shift: int = 4) -> DataFrame:
    """The dominant colour: the fullest bucket of ``shift``-bit channels, therein the most frequent exact value; of
    equals the nearest to the bucket's centroid, then the first seen. Distances are exact: scaled by the bucket's count.
    """
    buckets = [F.shiftright(F.col(c), shift).alias(f"_{c}") for c in channels]
    exact = df.groupBy(*groups, *buckets, *channels).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    b = W.partitionBy(*groups, *[f"_{c}" for c in channels])
    total = F.sum("n").over(b)
    far = sum(((F.col(c) * total - F.sum(F.col(c) * F.col("n")).over(b)) * (F.col(c) * total - F.sum(F.col(c) * F.col("n")).over(b)) for c in channels), F.lit(0))
    exact = exact.withColumn("bucket_count", total).withColumn("bucket_seen", F.min("first_seen").over(b)).withColumn("far", far)
    return top_one(exact, groups, [F.desc("bucket_count"), F.col("bucket_seen"), F.desc("n"), F.col("far"), F.col("first_seen")]).select(
        *groups, *channels, F.col("n").alias("value_count"), "bucket_count"
    )


def merge_problems(members: DataFrame, same: Sequence[str], most: int = 100) -> DataFrame:
    """merged and problem: why its members (merged, position, and the columns that must be alike) can't be chained.

    ``different <column>`` for the first of the columns in which two members differ, ``too many members``; null if none.
    """
    kinds = members.groupBy("merged").agg(F.count("*").alias("_n"), *[(F.count_distinct(F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())) > 1).alias(f"_{c}") for c in same])
    problem = F.when(F.col("_n") > most, "too many members")
    for c in same:
        problem = problem.when(F.col(f"_{c}"), f"different {c}")
    return kinds.select("merged", problem.alias("problem"))


def rewritten_key(key: Column, old: Column, new: Column, shift: Column | int = 0) -> Column:
    """A key of an owner or of its frame (``owner`` or ``owner:frame``) under a new owner, the frame moved by the shift;
    keys of other owners stay."""
    frame = F.regexp_extract(key, r":(\d+)$", 1).try_cast("bigint")
    own = key.startswith(F.concat(old, F.lit(":")))
    tail = F.substr(key, F.length(old) + 1)
    moved = F.when(frame.isNotNull(), F.concat(F.regexp_replace(tail, r"\d+$", ""), (frame + shift).cast("string"))).otherwise(tail)
    return F.when(key == old, new).when(own, F.concat(new, moved)).otherwise(key)


def renamed(bindings: DataFrame, names: DataFrame, owner: str, columns: Sequence[str]) -> DataFrame:
    """bindings with their owner and their key columns under the new name; names: old, new. Owners without one stay."""
    both = bindings.join(names.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(owner) == F.col("_old"), "left")
    keys = {c: F.when(F.col("_new").isNotNull(), rewritten_key(F.col(c), F.col("_old"), F.col("_new"))).otherwise(F.col(c)) for c in columns}
    return both.withColumns({**keys, owner: F.coalesce("_new", owner)}).drop("_old", "_new")


def mirrored(x: Column, rotation: Column, flipped: Column) -> Column:
    """Struct (x, rotation) of a box on a frame that is turned around, both with their sign changed."""
    turn = lambda c: F.when(F.coalesce(flipped, F.lit(False)), -c).otherwise(c)
    return F.struct(turn(x).alias("x"), turn(rotation).alias("rotation"))


def still_used(assets: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Assets that a binding names."""
    return assets.join(bindings.select(*keys), list(keys), "left_semi")


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of all its objects in order and without blanks; null where it doesn't parse."""
    return F.to_json(F.try_parse_json(text))
