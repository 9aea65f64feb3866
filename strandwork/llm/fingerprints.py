"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its runs of five words (the whole sequence if it has fewer); its sketch is the k smallest of the
distinct hashes of its shingles, in order. The sketch of two parts' shingles together is the k smallest of their
sketches, so parts can be sketched apart and merged. Two sketches estimate resemblance (the share of the k smallest of
the union that both have), containment and the number of distinct shingles; of sets of up to k shingles these are exact.

Everything is a column expression: there is no Python, and arrays are bound once in the functions that walk them.

fingerprint_report gives each document its fingerprint, that of an edited text which ends in the next document's
beginning, and two likenesses. To meet its next document, a text moves once, into a block of some hundred neighbouring
ids; the first document of each block also goes to the block before. Ids alone are read first, to cut the blocks at ids
that occur; at most BLOCKS numbers pass the driver.

Defined results: words are runs of [^\\x20\\x09-\\x0D], case counts; null texts are empty; a text without words has the
empty sketch, which is like itself (1) and like no other (0). Documents stand by doc_id downwards, null ids last, rows of
one id by their text's hash; equal rows may change places, which changes no result. Rows of one id meet in one block,
which is spilled to disk where it is large. Columns besides doc_id and text are not read. An empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.common import whole

WIDTH, K = 5, 100
#: Hexadecimal digits of a hash.
DIGITS = 12
#: Documents of a block, and the most blocks.
ROWS, BLOCKS = 256, 50_000


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of a text, in order."""

    def of(words: Column) -> Column:
        shingle = lambda w, i: F.substring(F.md5(F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, width)))), 1, DIGITS)
        return F.slice(F.transform(words, shingle), 1, F.greatest(F.size(words) - (width - 1), F.lit(1)))

    return _let(F.array_remove(F.split(whole(text), r"[\x20\x09-\x0D]+"), ""), of)


def sketch(text: Column, width: int = WIDTH, k: int = K) -> Column:
    """The k smallest distinct hashes, sorted."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two sketched parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(sketches: DataFrame, by: str, k: int = K) -> DataFrame:
    """sketches (by, sketch) -> by, sketch: the merged sketch of each group.

    Each hash counts once a group; of a group's hashes each task passes on the k smallest at most, so a large group
    doesn't meet in one task.
    """
    each = sketches.select(by, F.explode("sketch").alias("hash")).groupBy(by, "hash").agg(F.lit(1).alias("one"))
    least = each.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("hash"))).where(F.col("rank") <= k)
    return least.groupBy(by).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    full = 16.0**DIGITS
    largest = F.conv(F.element_at(a, -1), 16, 10).cast("double") + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * full / largest)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that both have; 1 for two empty sketches."""
    share = _let(merged(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; null if a is empty."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def _first_not_below(cuts: list[int], doc_id: Column) -> Column:
    """The place of the smallest cut that is not below the id, by halving."""
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts) - 1).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(table, middle) < doc_id
        move = s["low"] < s["high"]
        return F.struct(F.when(move & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(move & ~below, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(steps, start, halve, lambda s: s["low"])


def with_next(docs: DataFrame, block: int = ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, sketch, next_text, next_sketch, by descending doc_id; after the last: the first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    n = docs.agg(F.count("doc_id"), F.count(F.lit(1))).first()
    if not n[1]:
        return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("sketch", "array<string>"), ("next_text", "string"), ("next_sketch", "array<string>"))))
    parts = max(1, min(BLOCKS, n[0] // block))
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts + 1)], 20 * parts), F.max(F.col("doc_id").cast("long"))).first()
    cuts = sorted({*(found[0] or []), *([found[1]] if n[0] else [])})
    no_id = n[0] < n[1]
    first_without = rows.where("doc_id IS NULL").agg(F.min(F.sha2("text", 256))).first()[0] if no_id else ""
    top, last = len(cuts) - 1, -1 if no_id else 0
    if cuts:
        slot = F.when(F.col("doc_id").isNull(), -1).otherwise(_first_not_below(cuts, F.col("doc_id")))
        ends = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    else:
        slot, ends = F.lit(-1), F.array().cast("array<long>")
    rows = rows.withColumn("slot", slot)
    starts = F.when(F.col("slot") < 0, F.sha2("text", 256) == first_without).otherwise(F.get(ends, F.greatest("slot", F.lit(0))) == F.col("doc_id"))
    before = F.when(F.col("slot") < 0, 0 if cuts else -1).when(F.col("slot") == top, last).otherwise(F.col("slot") + 1)
    own, ahead = F.struct(F.col("slot").alias("block"), F.lit(False).alias("shown")), F.struct(before.alias("block"), F.lit(True).alias("shown"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(starts, F.array(own, ahead)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("doc_id", "text", "at.block", "at.shown").repartition("block").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("block").orderBy("shown", F.desc_nulls_last("doc_id"), F.sha2("text", 256))
    met = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return met.where(~F.col("shown")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprint(a: Column) -> Column:
    return F.array_join(a, "")


def fingerprint_report(docs: DataFrame, block: int = ROWS) -> DataFrame:
    """docs -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third))
    rows = with_next(docs, block).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    a, b, c = (F.col(x) for x in ("sketch", "edited_sketch", "next_sketch"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"),
    )


#: The same rows; the next document comes by one window over all ids.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER o AS after, first_value(coalesce(text, '')) OVER o AS top
  FROM documents WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, sha256(coalesce(text, '')))),
e AS (
  SELECT row_number() OVER () AS rid, doc_id, text, coalesce(after, top) AS next_text,
         left(text, length(text) - length(text) // 3) || left(coalesce(after, top), length(text) // 3) AS edited FROM d),
t AS (SELECT rid, unnest([0, 1, 2]) AS kind, unnest([text, edited, next_text]) AS x FROM e),
w AS (SELECT rid, kind, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
h AS (SELECT rid, kind, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 12)) END) AS hash FROM w),
s AS (SELECT rid, kind, list(hash ORDER BY hash)[1:100] AS sketch FROM (SELECT DISTINCT rid, kind, hash FROM h) GROUP BY rid, kind),
p AS (
  SELECT e.*, coalesce(a.sketch, []) AS a, coalesce(b.sketch, []) AS b, coalesce(c.sketch, []) AS c
  FROM e LEFT JOIN s a ON a.rid = e.rid AND a.kind = 0 LEFT JOIN s b ON b.rid = e.rid AND b.kind = 1 LEFT JOIN s c ON c.rid = e.rid AND c.kind = 2),
u AS (SELECT *, list_sort(list_distinct(a || b))[1:100] AS ab, list_sort(list_distinct(a || c))[1:100] AS ac FROM p)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(ab) = 0 THEN 1.0 ELSE len(list_filter(ab, lambda z: list_contains(a, z) AND list_contains(b, z)))::DOUBLE / len(ab) END AS near_edited,
       CASE WHEN len(ac) = 0 THEN 1.0 ELSE len(list_filter(ac, lambda z: list_contains(a, z) AND list_contains(c, z)))::DOUBLE / len(ac) END AS near_next
FROM u
"""
