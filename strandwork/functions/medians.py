"""Medians and percentiles whose index rules differ from Spark's built-ins, without gathering a group.

Values are counted by a coarse key that rises with them, which finds the part of a group that holds each wanted rank;
only that part is counted by value. So no task sees more of a group than one part's distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts for each unit of a value's natural logarithm.
PARTS = 64


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def ranked_values(df: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """groups and, for each name in ranks, the value at the place (from 0) that its function of the group's number of
    values gives. Nulls don't count; groups without values are left out."""
    v = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    v = v.withColumn("_part", F.floor(F.signum(F.col("_v").cast("double")) * F.log1p(F.abs(F.col("_v").cast("double"))) * PARTS))
    by = W.partitionBy(*groups)
    parts = v.groupBy(*groups, "_part").agg(F.count("*").alias("_k"))
    parts = parts.withColumn("_upto", F.sum("_k").over(by.orderBy("_part"))).withColumn("_n", F.sum("_k").over(by))
    names = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("_n")).cast("long").alias("at")) for name, f in ranks.items()]))
    wanted = parts.withColumn("_w", names).where((F.col("_w.at") >= F.col("_upto") - F.col("_k")) & (F.col("_w.at") < F.col("_upto")))
    keys = [f"_g{i}" for i in range(len(groups))]
    wanted = wanted.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col("_part").alias("_p"), F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_upto") + F.col("_k")).alias("_at"))
    there = _same([*groups, "_part"], [*keys, "_p"])
    held = v.join(wanted.select(*keys, "_p").distinct(), there, "left_semi").groupBy(*groups, "_part", "_v").agg(F.count("*").alias("_k"))
    held = held.withColumn("_upto", F.sum("_k").over(W.partitionBy(*groups, "_part").orderBy("_v")))
    found = held.join(wanted, there).where((F.col("_at") >= F.col("_upto") - F.col("_k")) & (F.col("_at") < F.col("_upto")))
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])


def ranked_columns(df: DataFrame, groups: Sequence[str], ranks: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """groups and, for each name in ranks, the value of its column at the place that its function of the number of that
    column's values gives: as ``ranked_values``, for several columns of one type of number with one reading of the table."""
    columns = list(dict.fromkeys(c for c, _ in ranks.values()))
    each = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).alias("_x")) for c in columns])).alias("_m"))
    found = ranked_values(each.select(*groups, "_m._of", "_m._x"), [*groups, "_of"], "_x", {name: f for name, (_, f) in ranks.items()})
    return found.groupBy(*groups).agg(*[F.max(F.when(F.col("_of") == c, F.col(name))).alias(name) for name, (c, _) in ranks.items()])


def upper_medians(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """groups, middle: the element at floor(n / 2) of the sorted values, the upper middle for an even count."""
    return ranked_values(df, groups, value, {"middle": lambda n: F.floor(n / 2)})


def summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """groups, n, least, most, middle (the mean of the two middle ones), total of a measure's values; nulls don't count."""
    sides = ranked_values(df, groups, value, {"_lower": lambda n: F.floor((n - 1) / 2), "_upper": lambda n: F.floor(n / 2)})
    sums = df.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.sum(value).alias("total"))
    return sums.join(sides, list(groups), "left").select(*groups, "n", "least", "most", ((F.col("_lower") + F.col("_upper")) / 2).alias("middle"), "total")
