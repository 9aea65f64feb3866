"""Language-model scores by stupid backoff, with the counts of the whole corpus.

A document's tokens are scored under the counts of all other documents: S(w | u v) = c(uvw) / c(uv) where the trigram
occurs elsewhere, else 0.4 times the bigram's S(w | v), else 0.4 times the word's share. So text that nobody else writes
backs off, and copies score high.

N-grams of orders 1 to 3 form count tables partitioned by hash. They travel packed: a task counts the n-grams of a block
of documents (some megabytes of text), and sends each partition the block's distinct n-grams in one row; the partition
joins all blocks' n-grams, sums their counts, and returns each block the totals in the order it sent; there they meet
the documents' own n-grams and are summed a document. The tables are thus exact over all rows, grow with the corpus, and
a frequent n-gram is one entry a block, so that no key is hot. Rows are
compressed, which their order makes worth while.

N-grams are told apart by a hash over the whole corpus and are not verified: the partition and the place in it are its
upper 32 bits, and as many bytes of the rest follow as keep the chance that an n-gram is merged with another below
2 ** -MARGIN at the corpus' own size (56 bits up to 4 billion n-grams, then 64). Rows a (n-gram, document) pair would
take some twelve times the input on disk, hence the packing.

Blocks are found again by re-reading documents in the same partitions, as files give them; documents that come out of a
shuffle are stored first. A block that isn't found again raises an error. Columns besides doc_id and text are not read.

Defined results: tokens are A-Z lower-cased runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; null and empty texts and texts
without tokens have score null and 0 words. A word found in no other document has the share 0.4 of one word. Repeated
rows count as other documents; a corpus of one document has no other counts, and backs off throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import alnum_words, mix64, raw, stored, word_hashes

ALPHA = 0.4
ORDER = 3
#: Bits that tell n-grams apart beyond those that number them.
MARGIN = 24
#: Text of a block in bytes; n-grams a partition of the count tables.
BLOCK, BUCKET = 6 << 20, 2_000_000

_U = np.uint64


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's number of words."""
    parts = [word_hashes(alnum_words(t)) for t in texts]
    return np.concatenate([*parts, np.empty(0, np.uint64)]), np.array([len(p) for p in parts], np.int64)


def _codes(h: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """n-gram codes ending at the places that have enough words before them."""
    at = np.flatnonzero(place >= order - 1)
    code = np.full(len(at), order, np.uint64)
    for k in range(order):
        code = code * _U(0x9E3779B97F4A7C15) + h[at - order + 1 + k]
    return mix64(code)


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's document and its place therein."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[object, bytes]]]:
    """Rows (doc_id, text) in blocks of about BLOCK bytes; the same for the same partition."""
    rows: list = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_buffer().to_pybytes()
            rows.append((i, t))
            size += len(t) + 16
            if size >= BLOCK:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _name(rows: list[tuple[object, bytes]], ordinal: int) -> int:
    """A block's name from its place and its content."""
    h = xxhash.xxh3_64(f"{TaskContext.get().partitionId()}:{ordinal}".encode())
    for i, t in rows:
        h.update(f"{i}:{len(t)}:".encode())
        h.update(t)
    return int(np.uint64(h.intdigest()).astype(np.int64))


def _pack_small(x: np.ndarray) -> bytes:
    """Counts as bytes; those over 254 follow whole."""
    big = x > 254
    return np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype(np.int64).tobytes()


def _unpack_small(b: bytes, n: int, at: int = 0) -> np.ndarray:
    x = np.frombuffer(b, np.uint8, n, at).astype(np.int64)
    x[x == 255] = np.frombuffer(b, np.int64, -1, at + n)
    return x


def rest_bytes(corpus: int) -> int:
    """Bytes of a hash beyond its upper 32 bits, for a corpus of so many words."""
    return min(4, max(1, math.ceil((math.log2(max(2, ORDER * corpus)) + MARGIN - 32) / 8)))


def _pack_codes(place: np.ndarray, code: np.ndarray, times: np.ndarray, rest: int) -> bytes:
    """A partition's n-grams of a block: rising 32-bit places as byte planes of their steps, more bytes of the hash, counts."""
    steps = np.diff(place, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    more = code.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 4 - rest :].T
    body = np.uint32(len(place)).tobytes() + steps.tobytes() + more.tobytes() + _pack_small(times)
    return zstandard.ZstdCompressor(1).compress(body)


def _unpack_codes(b: bytes, rest: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes within the partition, and counts."""
    b = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(b, np.uint32, 1)[0])
    plane = lambda width, at: np.frombuffer(b, np.uint8, width * n, at).reshape(width, n).T
    steps = np.ascontiguousarray(plane(4, 4)).view("<u4").ravel()
    more = np.zeros((n, 4), np.uint8)
    more[:, 4 - rest :] = plane(rest, 4 + 4 * n)
    code = np.cumsum(steps, dtype=np.uint64) << _U(32) | more.view("<u4").ravel()
    return code, _unpack_small(b, n, 4 + (4 + rest) * n)


def _counter(buckets: int, rest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in enumerate(_blocks(batches)):
            h, n = _tokens([t for _, t in rows])
            _, place = _places(n)
            code, times = np.unique(np.concatenate([_codes(h, place, o + 1) for o in range(ORDER)]), return_counts=True)
            if not len(code):
                continue
            spread = (code >> _U(32)) * _U(buckets)  # rises with the code: the partition, then the place in it
            bucket, within = spread >> _U(32), spread.astype(np.uint32)
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(code)]])
            out = [(int(bucket[a]), _pack_codes(within[a:b], code[a:b], times[a:b], rest)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            block = _name(rows, k)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([block] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "block", "packed"])

    return count


def _joiner(rest: int):
    """A partition of the count tables: every block's n-grams get their totals."""

    def join(table: pa.Table) -> pa.Table:
        codes, times = zip(*(_unpack_codes(v.as_buffer().to_pybytes(), rest) for v in table.column("packed")), strict=True)
        size = np.cumsum([0, *map(len, codes)])
        _, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(at, np.concatenate(times)).astype(np.int64)[at]
        packed = [zstandard.ZstdCompressor(1).compress(_pack_small(total[a:b])) for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
        sizes = [b - a for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["block", "bucket", "n", "packed"])

    return join


def _tagger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's documents in one compressed row."""
    kind = None
    for k, rows in enumerate(_blocks(_seen(batches, kinds := []))):
        kind = kind or kinds[0]
        held = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], kind), pa.array([t for _, t in rows], pa.binary())], names=["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(held)
        yield pa.RecordBatch.from_arrays([pa.array([_name(rows, k)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "held"])


def _seen(batches, kinds: list):
    for b in batches:
        kinds.append(b.schema.field(0).type)
        yield b


def _log_scores(h, n, total, corpus) -> np.ndarray:
    """Each document's sum of log scores. total: counts over the corpus of the sorted distinct codes."""
    of, place = _places(n)
    codes = [_codes(h, place, k + 1) for k in range(ORDER)]
    size = np.cumsum([0, *map(len, codes)])
    _, at = np.unique(np.concatenate(codes), return_inverse=True)
    docs = np.concatenate([of[place >= k] for k in range(ORDER)])
    _, mine, own = np.unique(docs * len(total) + at, return_inverse=True, return_counts=True)
    others = (total[at] - own[mine]).astype(np.float64)
    c = []
    for k in range(ORDER):
        full = np.zeros(len(h))
        full[place >= k] = others[size[k] : size[k + 1]]
        c.append(full)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    rest = np.maximum(corpus - n[of], 1).astype(np.float64)
    s = np.where(c[0] > 0, c[0], ALPHA) / rest
    for k in range(1, ORDER):
        context = before(c[k - 1])
        seen = (place >= k) & (c[k] > 0)
        s = np.where(seen, c[k] / np.maximum(context, 1), np.where(place >= k, ALPHA * s, s))
    return np.bincount(of, np.log(s), len(n)) if len(h) else np.zeros(len(n))


def _scorer(corpus: int):
    def score(held: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(held):
            raise ValueError("the documents came in other partitions the second time; store them first")
        docs = pa.concat_tables([pa.ipc.open_stream(v.as_buffer()).read_all() for v in held.column("held")])
        texts = [v.as_buffer().to_pybytes() for v in docs.column("text")]
        h, n = _tokens(texts)
        replies = replies.sort_by("bucket")
        total = [_unpack_small(zstandard.ZstdDecompressor().decompress(v.as_buffer().to_pybytes()), k) for k, v in zip(replies.column("n").to_pylist(), replies.column("packed"), strict=True)]
        if len(h) and not total:
            raise ValueError("the documents came in other partitions the second time; store them first")
        sums = _log_scores(h, n, np.concatenate([*total, np.empty(0, np.int64)]), corpus)
        some = n > 0
        mean = np.where(some, sums / np.maximum(n, 1), 0)
        return pa.table([docs.column("doc_id"), pa.array(n), pa.array(sums, mask=~some), pa.array(mean, mask=~some)], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    return score


@F.arrow_udf(T.LongType())
def _count_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(alnum_words(t)) for t in texts.to_pylist()], pa.int64())


def score_documents(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, log_score (natural, summed), mean_log_score; a row for each row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    corpus = docs.select(_count_words(raw("text")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(ORDER * corpus / 2 / BUCKET))
    rows = docs.select("doc_id", raw("text").alias("text"))
    rest = rest_bytes(corpus)
    sent = rows.mapInArrow(_counter(buckets, rest), "bucket long, block long, packed binary")
    totals = sent.groupBy("bucket").applyInArrow(_joiner(rest), "block long, bucket long, n long, packed binary")
    tagged = rows.mapInArrow(_tagger, "block long, held binary")
    return tagged.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _scorer(corpus), f"doc_id {kind}, n_words long, log_score double, mean_log_score double"
    )


def score_report(docs: DataFrame) -> DataFrame:
    """score_documents with scores to four decimals, so that they don't hang on the order of sums."""
    four = lambda c: (F.floor(F.col(c) * 10_000 + 0.5) / 10_000).alias(c)
    return score_documents(docs).select("doc_id", "n_words", four("log_score"), four("mean_log_score"))


#: The same scores from count tables of the n-grams themselves, joined to the exploded n-grams.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT rid, len(w) AS n, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS pos FROM d),
t AS (SELECT rid, n, pos, lag(c, 2) OVER o AS a, lag(c) OVER o AS b, c FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
own1 AS (SELECT rid, c, count(*) AS k FROM t GROUP BY ALL),
own2 AS (SELECT rid, b, c, count(*) AS k FROM t WHERE pos > 1 GROUP BY ALL),
own3 AS (SELECT rid, a, b, c, count(*) AS k FROM t WHERE pos > 2 GROUP BY ALL),
one AS (SELECT rid, c, sum(k) OVER (PARTITION BY c) - k AS others FROM own1),
two AS (SELECT rid, b, c, sum(k) OVER (PARTITION BY b, c) - k AS others FROM own2),
three AS (SELECT rid, a, b, c, sum(k) OVER (PARTITION BY a, b, c) - k AS others FROM own3),
x AS (
  SELECT t.rid, t.pos, greatest((SELECT sum(len(w)) FROM d) - t.n, 1)::DOUBLE AS rest, u.others AS c1, v.others AS c2, w3.others AS c3,
         uc.others AS context1, vc.others AS context2
  FROM t JOIN one u ON u.rid = t.rid AND u.c = t.c
  LEFT JOIN two v ON v.rid = t.rid AND v.b = t.b AND v.c = t.c
  LEFT JOIN three w3 ON w3.rid = t.rid AND w3.a = t.a AND w3.b = t.b AND w3.c = t.c
  LEFT JOIN one uc ON uc.rid = t.rid AND uc.c = t.b
  LEFT JOIN two vc ON vc.rid = t.rid AND vc.b = t.a AND vc.c = t.b),
s1 AS (SELECT *, CASE WHEN c1 > 0 THEN c1::DOUBLE ELSE 0.4::DOUBLE END / rest AS s FROM x),
s2 AS (SELECT * REPLACE (CASE WHEN pos = 1 THEN s WHEN c2 > 0 THEN c2::DOUBLE / greatest(context1, 1) ELSE 0.4::DOUBLE * s END AS s) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN pos <= 2 THEN s WHEN c3 > 0 THEN c3::DOUBLE / greatest(context2, 1) ELSE 0.4::DOUBLE * s END AS s) FROM s2),
l AS (SELECT rid, sum(ln(s)) AS score FROM s3 GROUP BY rid)
SELECT doc_id, len(w) AS n_words, floor(score * 10000 + 0.5) / 10000 AS log_score, floor(score / len(w) * 10000 + 0.5) / 10000 AS mean_log_score
FROM d LEFT JOIN l ON l.rid = d.rid
"""
