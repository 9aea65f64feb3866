"""Mixing sources to target weights, in native DataFrame operations.

Source token shares are raised to an exponent (1: in proportion, 0: equal weights). The exponent is bisected: the
largest one whose weights reach the target entropy, but no smaller than the least one that keeps every source within
the repetition limit. Each source then gets ``floor(weight * budget)`` tokens, spent as whole passes over its documents
and one partial pass. A pass is a permutation of blocks: documents fall into blocks of about ``block_tokens`` tokens by
a keyed hash, blocks are ordered by another, and the partial pass takes blocks in that order, and documents in the last
block, while they fit the budget.

A source's documents are never gathered: documents meet in their block's window, block totals in one of the 4,096
parts of their source's order, and only the totals of these parts in a source's. Sums over documents are of integers and those over sources of decimals, so they don't depend on their order.

Defined results: a document's tokens are its words (``[^\\x20\\x09-\\x0D]+``); documents without any, null texts
included, cannot fill a budget and are not drawn. A null source is a source. Rows are told apart by id and text; equal
rows are drawn alike (their order among themselves is arbitrary). An empty table gives an empty mixture. Texts of any
length are one document, drawn whole; where a budget asks for more passes over all sources than the limit allows, each
source stops at the limit and the mixture falls short of the budget. Other columns of docs are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.llm.common import stored, whole

#: Share of the largest possible entropy (that of equal weights) to reach, and the most passes over any source.
ENTROPY, REPEATS = 0.98, 4.0
BLOCK_TOKENS = 1 << 16
STEPS_A_PASS, PASSES = 4, 10  # 40 bisection steps in 10 small jobs
#: Lower bits of a block's order within a part of its source; the upper ones number 4,096 parts.
PART_BITS = 52
SEED = 7


def _exact(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,18)")).cast("double")


def _at(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most passes over a source at a budget of all tokens) of the weights at each exponent."""
    aggs = []
    for i, a in enumerate(exponents):
        w = F.pow(F.col("share"), F.lit(a))
        aggs += [_exact(w).alias(f"z{i}"), _exact(w * F.log("share")).alias(f"l{i}"), F.max(w / F.col("share")).alias(f"r{i}")]
    row = shares.agg(*aggs).first()
    out = []
    for i, a in enumerate(exponents):
        z = row[f"z{i}"]
        out.append((math.log(z) - a * row[f"l{i}"] / z, row[f"r{i}"] / z))
    return out


def _bisect(shares: DataFrame, below) -> float:
    """The exponent where below(entropy, passes) turns from true to false as the exponent grows from 0 to 1.

    The interior points of four halvings are evaluated together.
    """
    low, high, n = 0.0, 1.0, 1 << STEPS_A_PASS
    for _ in range(PASSES):
        points = [low + (high - low) * k / n for k in range(1, n)]
        true = sum(1 for e, r in _at(shares, points) if below(e, r))
        low, high = low + (high - low) * true / n, low + (high - low) * (true + 1) / n
    return low


def find_exponent(shares: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget_share: float = 1.0) -> float:
    """shares: one row a source with its share of all tokens. The repetition limit goes before the entropy."""
    n = shares.count()
    if n < 2:
        return 1.0
    (_, flattest), (own, _) = _at(shares, [0.0, 1.0])
    found = 1.0
    if entropy is not None and own < entropy * math.log(n):
        found = _bisect(shares, lambda e, r: e >= entropy * math.log(n))
    if repeats is not None and flattest * budget_share > repeats:
        # passes fall as the exponent grows, so the limit is met from some exponent on; step just past it
        found = max(found, min(1.0, _bisect(shares, lambda e, r: r * budget_share > repeats) + 2.0 ** -(STEPS_A_PASS * PASSES)))
    return found


def weigh(totals: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: int | None = None) -> DataFrame:
    """totals (source, tokens) -> source, tokens, weight, target: its tokens in the mixture. budget: None for all tokens."""
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    if not everything:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("target"))
    total = everything if budget is None else budget
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(everything)))
    a = find_exponent(shares, entropy, repeats, total / everything)
    z = shares.agg(_exact(F.pow(F.col("share"), F.lit(a)))).first()[0]
    w = shares.withColumn("weight", F.pow(F.col("share"), F.lit(a)) / F.lit(z))
    # a whole number of tokens that the weight's last bits miss still counts
    target = F.floor(F.col("weight") * F.lit(total * (1 + 1e-12)) + 1e-6)
    if repeats is not None:
        target = F.least(target, F.floor(F.col("tokens") * F.lit(float(repeats))))
    return w.select("source", "tokens", "weight", target.cast("long").alias("target"))


def mix(
    docs: DataFrame,
    entropy: float | None = ENTROPY,
    repeats: float | None = REPEATS,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """docs (doc_id, source, text) -> one row for each time that a document is drawn.

    doc_id, source, n_tokens, epoch (from 1), block, block_order, doc_order: by epoch and these two orders the mixture
    is a permutation of blocks, sources interleaved.
    """
    words = F.regexp_count(whole("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = stored(
        docs.select("doc_id", "source", words.alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("key")).where("n_tokens > 0"),
        "tokens",
    )
    weights = stored(weigh(stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "totals"), entropy, repeats, budget), "weights")
    plan = weights.select(
        F.col("source").alias("s"),
        F.ceil(F.col("tokens") / block_tokens).alias("blocks"),
        F.floor(F.col("target") / F.col("tokens")).alias("whole"),
        (F.col("target") % F.col("tokens")).alias("rest"),
    )
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("blocks")))
    block = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    order = F.xxhash64(F.lit(seed + 2), "source", "block")
    block = stored(block.withColumn("order", order).withColumn("part", F.shiftright("order", PART_BITS)), "blocks")
    # running totals of a source's blocks: of its parts (a bounded number), then of the blocks in each part
    parts = block.groupBy("source", "part").agg(F.sum("size").alias("of_part"))
    earlier = F.coalesce(F.sum("of_part").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), earlier.alias("earlier"))
    block = block.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    run = W.partitionBy("source", "part").orderBy("order", "block")
    ended = F.col("earlier") + F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0))
    left = block.withColumn("left", F.greatest(F.col("rest") - (ended - F.col("size")), F.lit(0))).select(
        F.col("source").alias("s"), F.col("block").alias("b"), F.col("left"), "size"
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    drawn = placed.join(left, same).drop("s", "b")
    within = W.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 3), "key"), "key").rowsBetween(W.unboundedPreceding, 0)
    fits = (F.col("left") >= F.col("size")) | (F.sum("n_tokens").over(within) <= F.col("left"))
    drawn = drawn.withColumn("copies", F.col("whole") + fits.cast("long")).where("copies > 0")
    return drawn.select("doc_id", "source", "n_tokens", "block", "key", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("epoch")).select(
        "doc_id",
        "source",
        "n_tokens",
        "epoch",
        "block",
        F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("block"), F.col("epoch")).alias("block_order"),
        F.xxhash64(F.lit(seed + 3), F.col("key"), F.col("epoch")).alias("doc_order"),
    )


def weight_report(docs: DataFrame) -> DataFrame:
    """docs (source, text) -> source, tokens, weight_ppm (millionths), target at the default limits."""
    words = F.regexp_count(whole("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    totals = docs.select("source", words.alias("tokens")).where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return weigh(stored(totals, "totals")).select("source", "tokens", F.floor(F.col("weight") * 1000000 + 0.5).cast("long").alias("weight_ppm"), "target")


_HALVINGS = STEPS_A_PASS * PASSES
#: The same rows in DuckDB's SQL: both limits bisected one halving at a time, over the list of shares.
WEIGHT_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT source, sum(n)::BIGINT AS tokens FROM (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents) WHERE n > 0 GROUP BY source),
l AS (SELECT list(tokens::DOUBLE / every) AS x, count(*) AS n, any_value(every) AS every FROM t, (SELECT sum(tokens) AS every FROM t)),
h AS (
  SELECT 0 AS k, 0.0::DOUBLE AS e, 0.0::DOUBLE AS r, x, n FROM l
  UNION ALL
  SELECT k + 1, CASE WHEN ln(ze) - (e + w) * se / ze >= {ENTROPY} * ln(n) THEN e + w ELSE e END, CASE WHEN mr / zr > {REPEATS} THEN r + w ELSE r END, x, n
  FROM (SELECT *, list_sum(list_transform(x, lambda v: pow(v, e + w))) AS ze, list_sum(list_transform(x, lambda v: pow(v, e + w) * ln(v))) AS se,
               list_sum(list_transform(x, lambda v: pow(v, r + w))) AS zr, list_max(list_transform(x, lambda v: pow(v, r + w) / v)) AS mr
        FROM (SELECT *, pow(0.5::DOUBLE, k + 1) AS w FROM h WHERE k < {_HALVINGS}))),
a AS (
  SELECT CASE WHEN n < 2 THEN 1 ELSE greatest(CASE WHEN -list_sum(list_transform(x, lambda v: v * ln(v))) >= {ENTROPY} * ln(n) THEN 1 ELSE e END,
                                               CASE WHEN 1 / list_min(x) / n > {REPEATS} THEN least(1, r + pow(0.5::DOUBLE, {_HALVINGS})) ELSE 0 END) END AS a
  FROM h WHERE k = {_HALVINGS}),
w AS (SELECT t.*, every, pow(tokens::DOUBLE / every, a) / list_sum(list_transform(x, lambda v: pow(v, a))) AS weight FROM t, l, a)
SELECT source, tokens, floor(weight * 1000000 + 0.5)::BIGINT AS weight_ppm,
       least(floor(weight * (every * (1 + 1e-12::DOUBLE)) + 1e-6::DOUBLE), floor(tokens * {REPEATS}::DOUBLE))::BIGINT AS target FROM w
"""
