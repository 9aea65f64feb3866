"""Benchmark decontamination.

The benchmark's windows of ``width`` normalised words (an item with fewer, but not none, is one window) form a hash
set that is broadcast after its size has been checked. A document's words become vocabulary numbers, unknown words 0;
only windows without an unknown word are hashed and looked up, and each hit is verified word by word. A benchmark over
``MAX_INDEX_WORDS`` is not broadcast: its windows are then joined to the documents' windows by hash and verified.

Defined results: null and empty texts have no words and no hits; null and empty items have no windows. An item_id is
one item, however often it recurs; items without an id mark words as hit but are not listed. Repeated rows and extra
columns pass through; an empty benchmark marks nothing.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import ALNUM, alnum_words, fresh, mix64, raw, stored, whole, word_hashes

WIDTH = 10
#: Words of a benchmark whose index (at most about 150 bytes a word) may be broadcast.
MAX_INDEX_WORDS = 2_000_000
#: Bits of the bitmap that a larger benchmark's windows are looked up in (16 MB).
BITS = 27
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


class Index:
    """The windows of a benchmark by length: sorted hashes, and where in the benchmark's words each window stands."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        rng = np.random.default_rng(20)
        self.factors = rng.integers(1, 2**63, width, np.int64).astype(np.uint64) | np.uint64(1)
        flat: list[int] = []
        starts: dict[int, list[tuple[int, int]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            size = min(width, len(ids))
            if size:
                starts.setdefault(size, []).extend((len(flat) + k, len(self.names)) for k in range(len(ids) - size + 1))
            flat += ids
            self.names.append(name)
        self.flat = np.array(flat, np.uint64)
        self.sizes = {}
        for size, found in starts.items():
            at, item = np.array(found, np.int64).T
            code = self.code(self.flat, at, size)
            order = np.argsort(code, kind="stable")
            self.sizes[size] = (code[order], at[order], item[order])

    def code(self, ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in range(size):
            out = out * self.factors[0] + ids[at + k] * self.factors[k]
        return out

    def scan(self, text: bytes) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        words = alnum_words(text)
        n = len(words)
        if not n or not self.sizes:
            return n, 0, [], []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, n)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        edge, items = None, set()
        for size, (codes, at, item) in self.sizes.items():
            if n < size:
                continue
            full = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(full):
                continue
            code = self.code(ids, full, size)
            low, high = np.searchsorted(codes, code, "left"), np.searchsorted(codes, code, "right")
            for p, i, j in zip(full[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                for k in range(i, j):
                    if np.array_equal(self.flat[at[k] : at[k] + size], ids[p : p + size]):  # verified, not only hashed
                        edge = np.zeros(n + 1, np.int32) if edge is None else edge
                        edge[p] += 1
                        edge[p + size] -= 1
                        items.add(self.names[item[k]])
        if edge is None:
            return n, 0, [], []
        hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
        bounds = np.flatnonzero(hit[1:] != hit[:-1]).tolist()
        return n, int(hit.sum()), sorted(x for x in items if x is not None), list(zip(bounds[::2], bounds[1::2], strict=True))


def _scanner(index) -> object:
    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        use = index.value
        n, hit, items, spans = zip(*map(use.scan, texts.to_pylist()), strict=True) if len(texts) else ([], [], [], [])
        spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((n, hit, items, spans), _ARROW, strict=True)], fields=list(_ARROW))

    return scan.asNondeterministic()


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_words: int = MAX_INDEX_WORDS) -> tuple[DataFrame, str]:
    """docs with a struct n_words, n_hit, items, spans (word numbers, end exclusive); and that column's name."""
    name = fresh(docs.columns, "hits")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), raw("text").alias("text"))
    words = benchmark.agg(F.coalesce(F.sum(F.length(whole("text"))), F.lit(0)).alias("n")).first().n / 2
    if words <= max_words:
        index = Index([(r.item_id, bytes(r.text)) for r in items.collect()], width)
        scan = _scanner(docs.sparkSession.sparkContext.broadcast(index))
        return docs.withColumn(name, scan(raw("text"))), name
    return _mark_by_join(docs, benchmark, width, name), name


_WINDOWS = "doc_id {kind}, text_key long, at int, size int, code long, win binary"


def _window_rows(kind: str, width: int, sizes: list[int] | None, bits: bytes | None):
    """Windows of texts as rows: an item's own windows (sizes is None), or all windows of the sizes whose code is in bits."""

    def emit(batches):
        seen = None if bits is None else np.frombuffer(bits, np.uint8)
        for batch in batches:
            for i, key, text in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = alnum_words(text)
                if not words:
                    continue
                h = word_hashes(words)
                for size in sizes if sizes is not None else [min(width, len(words))]:
                    if len(words) < size:
                        continue
                    code = np.full(len(words) - size + 1, size, np.uint64)
                    for k in range(size):
                        code = code * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(code)]
                    code = mix64(code)
                    at = np.arange(len(code)) if seen is None else np.flatnonzero(seen[code >> np.uint64(64 - BITS + 3)] >> (code >> np.uint64(64 - BITS) & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([
                            pa.repeat(i, len(at)), pa.repeat(key, len(at)), pa.array(at, pa.int32()), pa.array(np.full(len(at), size), pa.int32()),
                            pa.array(code[at].view(np.int64)), pa.array([b" ".join(words[p : p + size]) for p in at.tolist()], pa.binary()),
                        ], names=["doc_id", "text_key", "at", "size", "code", "win"])

    return emit


def _bitmap(windows: DataFrame) -> bytes:
    """The codes' upper bits as a bitmap of a fixed size, put together in parts of 32,768 bits."""
    top = F.shiftrightunsigned("code", 64 - BITS) + 1  # bucket numbers count from 1
    parts = windows.select(F.bitmap_bucket_number(top).alias("part"), F.bitmap_bit_position(top).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(1 << BITS - 3)
    for r in parts.collect():  # at most 2 ** BITS / 32768 rows of 4 KB
        out[(r.part - 1) * 4096 : r.part * 4096] = bytes(r.bits)
    return bytes(out)


def _mark_by_join(docs: DataFrame, benchmark: DataFrame, width: int, name: str) -> DataFrame:
    """The same column for a benchmark too large to broadcast: windows meet in a join.

    Windows are hashed where their text is read. A bitmap of the benchmark's codes, of 2 ** BITS bits whatever the
    benchmark's size, lets only windows through that may be hits, and these are joined by code and compared word by word.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64(whole("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("doc_id"), key.alias("text_key"), raw("text").alias("text"))
    item = items.mapInArrow(_window_rows("string", width, None, None), _WINDOWS.format(kind="string"))
    item = stored(item.select(F.col("doc_id").alias("item_id"), "size", "code", "win").distinct(), "windows")
    sizes = [r.size for r in item.select("size").distinct().collect()]  # at most `width` rows
    texts = docs.select("doc_id", key.alias("text_key"), raw("text").alias("text"))
    seen = texts.mapInArrow(_window_rows(kind, width, sizes, _bitmap(item)), _WINDOWS.format(kind=kind)).distinct()
    hit = seen.join(item, ["size", "code", "win"]).select("doc_id", "text_key", "at", "size", "item_id")
    place = hit.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1))))).alias("p"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    p = F.col("p")
    starts = F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i - 1) == x - 1, F.lit(False)))
    ends = F.filter(p, lambda x, i: ~F.coalesce(F.get(p, i + 1) == x + 1, F.lit(False)))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    named: list[str] = []
    for want in ("of_id", "of_key", "n", "items", "spans"):
        named.append(fresh([*docs.columns, *named], want))
    place = place.select("doc_id", "text_key", F.size("p").cast("long"), "items", spans).toDF(*named)
    of_id, of_key, n, found, at = (F.col(c) for c in named)
    words = F.regexp_extract_all(whole("text"), F.lit(WORD.replace(r"\x60", r"\x40\x5B-\x60")), F.lit(0))
    return (
        docs.join(place, F.col("doc_id").eqNullSafe(of_id) & (key == of_key), "left")
        .select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.coalesce(n, F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce(found, F.array().cast("array<string>")).alias("items"),
                F.coalesce(at, F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
            ).alias(name),
        )
    )


@F.arrow_udf(T.StringType())
def _cut_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if cut:
            at = [m.span() for m in word.finditer(text.translate(ALNUM))]
            for s in reversed(cut):
                text = text[: at[s["start"]][0]] + text[at[s["end"] - 1][1] :]
        out.append(text.decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop: bool = True, width: int = WIDTH) -> DataFrame:
    """docs without their contaminated documents (drop), or with the hit spans cut out of the texts."""
    held, name = mark(docs, benchmark, width)
    hit = F.col(f"{name}.n_hit") > 0
    if drop:
        return held.where(~hit).select([F.col(f"`{c}`") for c in docs.columns])
    text = F.when(hit, _cut_spans(raw("text"), f"{name}.spans")).otherwise(F.col("text"))
    cols = [text.alias(c) if c == "text" else F.when(hit, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return held.select(cols)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    held, name = mark(docs.select("doc_id", "text"), benchmark)
    h = F.col(name)
    return held.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(h["items"]), ","), 256).alias("items_sha256"),
        (h["n_hit"] > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, size, list_slice(w, p, p + size - 1) AS win
  FROM (SELECT item_id, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS p FROM bl)),
dw AS (
  SELECT rid, size, p, list_slice(w, p, p + size - 1) AS win
  FROM (SELECT rid, w, size, unnest(range(1, (len(w) - size + 2)::BIGINT)) AS p
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT rid, p, dw.size AS size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""
