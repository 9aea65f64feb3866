"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document; the ledger keeps the measurements and one failure bit a rule. A policy is a
versioned set of rules, so applying another version, or measuring what a rule alone removes, reads the ledger and
never the texts again.

Defined results: null and empty texts have no words and fail ``too_few_words``; null ids, repeated rows and extra
columns pass through; texts of any length are measured whole; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import fresh, raw

#: Measurements of a text, all long.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_pipe_words", "n_shouted", "n_bangs"]
WINDOW = 5


def _rules(m: Column) -> list[tuple[str, Column]]:
    """Bit i of the ledger is rule i. Rules are only ever added at the end, so that old ledgers stay readable."""
    return [
        ("too_few_words", m["n_words"] < 10),
        ("repeated_windows", 100 * m["n_repeat_words"] > 20 * m["n_words"]),
        ("symbols", 100 * m["n_symbols"] > 15 * m["word_chars"]),
        ("table_cells", 100 * m["n_pipe_words"] > 20 * m["n_words"]),
        ("shouted", 100 * m["n_shouted"] > 50 * m["n_words"]),
        ("exclamations", 100 * m["n_bangs"] > 20 * m["n_words"]),
        ("dup_lines", (m["n_lines"] >= 4) & (100 * m["n_dup_lines"] > 50 * m["n_lines"])),
        ("word_length", (m["n_words"] > 0) & ((m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]))),
    ]


RULE_NAMES = ["too_few_words", "repeated_windows", "symbols", "table_cells", "shouted", "exclamations", "dup_lines", "word_length"]

#: Versioned policies: which rules reject a document.
POLICIES = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbols", "table_cells"],
    "v2": RULE_NAMES,
}
CURRENT = "v2"


def policy_mask(version: str) -> int:
    return sum(1 << RULE_NAMES.index(r) for r in POLICIES[version])


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of that many words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(code, twice)).tolist()
    windows = [tuple(words[p : p + width]) for p in at]  # equal hashes are confirmed on the words
    count = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int32)
    for p, w in zip(at, windows, strict=True):
        if count[w] > 1:
            edge[p] += 1
            edge[p + width] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure_text(text: bytes) -> list[int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    flat = np.frombuffer(b"".join(words), np.uint8)
    return [
        len(words),
        int(np.count_nonzero((flat & 0xC0) != 0x80)),
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        words.count(b"|"),
        sum(map(bytes.isupper, words)),
        text.count(b"!!"),
    ]


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    rows = [measure_text(t) for t in texts.to_pylist()]
    cols = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], MEASURES)


_measure = _measure.asNondeterministic()  # else a filter on the result would evaluate it a second time


def ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with a struct of measurements and a long of failure bits; and the names of the two columns."""
    m = fresh(docs.columns, "measures")
    bits = fresh([*docs.columns, m], "fail_bits")
    held = docs.withColumn(m, _measure(raw(F.col(f"`{text}`"))))
    failed = sum(
        (F.when(rule, F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(_rules(F.col(m)))), F.lit(0)
    )
    return held.withColumn(bits, failed.cast("long")), m, bits


def passes(bits: Column, version: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(policy_mask(version))) == 0


def keep_good(docs: DataFrame, text: str = "text", version: str = CURRENT) -> DataFrame:
    """The documents that a policy keeps, with the columns they had."""
    held, _, bits = ledger(docs, text)
    return held.where(passes(F.col(bits), version)).select([F.col(f"`{c}`") for c in docs.columns])


def ablations(bits: DataFrame, column: str = "fail_bits", version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone removes; one pass over the ledger.

    Rows: rule, n_failed, n_only, n_kept_without. Masked bit patterns are counted first, so at most 2 ** rules rows meet.
    Rows whose bits are null haven't been measured, and count nowhere.
    """
    mask = policy_mask(version)
    bits = bits.where(F.col(column).isNotNull())
    patterns = bits.select(F.col(column).bitwiseAND(F.lit(mask)).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    rules = bits.sparkSession.createDataFrame([(r, 1 << RULE_NAMES.index(r)) for r in POLICIES[version]], "rule string, bit long")
    hit = F.col("p").bitwiseAND(F.col("bit")) != 0
    rest = F.col("p").bitwiseAND(F.bitwise_not("bit"))
    return (
        rules.join(patterns, F.lit(True), "left")
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(hit & (rest == 0), F.col("n"))), F.lit(0)).alias("n_only"),
            F.coalesce(F.sum(F.when(rest == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base measurements, the failure bits, base_failed and the current policy's verdict."""
    held, m, bits = ledger(docs.select("doc_id", "text"))
    b = F.col(bits)
    return held.select(
        "doc_id",
        *[F.col(f"{m}.{x}").alias(x) for x in MEASURES[:5]],
        b.alias("fail_bits"),
        (~passes(b, "base")).alias("base_failed"),
        (passes(b, "base") & passes(b)).alias("kept"),
    )


def ablation_report(docs: DataFrame) -> DataFrame:
    """ablations of the current policy over the documents."""
    held, _, bits = ledger(docs.select("text"))
    return ablations(held, bits)


#: The same rows in DuckDB's SQL.
SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         string_split(coalesce(text, ''), chr(10)) AS all_lines
  FROM documents),
b AS (
  SELECT rid, doc_id, words, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(replace(t, '!!', '!')) AS n_bangs,
         list_filter(all_lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         len(list_filter(words, lambda x: x = '|')) AS n_pipe_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_shouted
  FROM w),
g AS (
  SELECT rid, p, list_slice(words, p, p + 4) AS win
  FROM (SELECT rid, words, unnest(range(1, n_words - 3)) AS p FROM b WHERE n_words >= 5)),
d AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM g),
r AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM d WHERE c > 1) GROUP BY rid),
m AS (
  SELECT b.rid, doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, n_pipe_words, n_shouted, n_bangs
  FROM b LEFT JOIN r ON r.rid = b.rid),
f AS (
  SELECT *, ((n_words < 10)::INT * 1 + (100 * n_repeat_words > 20 * n_words)::INT * 2
             + (100 * n_symbols > 15 * word_chars)::INT * 4 + (100 * n_pipe_words > 20 * n_words)::INT * 8
             + (100 * n_shouted > 50 * n_words)::INT * 16 + (100 * n_bangs > 20 * n_words)::INT * 32
             + (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT * 64
             + (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words))::INT * 128)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept
FROM f
"""

#: The ablations from the same ledger.
ABLATION_SQL = (
    SQL.rpartition("SELECT doc_id, n_words")[0]
    + """SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits = bit) AS n_only, count(*) FILTER (fail_bits & (255 - bit) = 0) AS n_kept_without
FROM (SELECT unnest(["""
    + ", ".join(f"'{r}'" for r in RULE_NAMES)
    + """]) AS rule, unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS bit) LEFT JOIN f ON true GROUP BY rule
"""
)
