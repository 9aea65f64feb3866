"""Resampling towards a target distribution, by importance weights over hashed n-grams.

Features are all runs of 1 to ``order`` consecutive words, hashed into buckets. Each task hands its texts, some megabytes
at a time, to DuckDB, which unnests the words, makes the n-grams by windows, hashes the distinct ones by a registered
CRC function, and counts buckets by document. These counts are spilled to Parquet in the shared folder. Spark merges them
into the two distributions, of which only the gains of the buckets pass the driver (one number a bucket, a parameter),
and scores the documents from the same spill, so that texts are read and counted once.

Weights get a Gumbel draw keyed by doc_id, so the highest scores are a sample without replacement in proportion to
exp(weight / 1000). Scores are whole numbers of a bounded range (logarithms of counts, times 1000), and the draw spreads
them: ranks come from a histogram by score and from the order within one score, and no task sorts all documents.

Defined results: null texts have no words, a document without features has weight 0; rows are documents, repeated ones
too; a null doc_id is written as nothing after the seed and stands after the others where scores tie. Empty tables have
no rows, and an empty target makes all gains hang on the documents alone. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwork.llm.common import raw, stored

ORDER, BUCKETS, SEED = 1, 10_000, "2024"
MIN_WORDS, PERCENT = 20, 10
#: Bytes of text that DuckDB gets at once, and its memory.
PIECE, MEMORY = 4 << 20, "300MB"

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _counts_sql(order: int) -> str:
    """Counts of buckets by document of the table piece (rid, text)."""
    gram = lambda n: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))])
    grams = "\n  UNION ALL ".join(f"SELECT rid, {gram(n)} AS gram FROM words" + " WINDOW o AS (PARTITION BY rid ORDER BY place)" * (n > 1) for n in range(1, order + 1))
    return f"""
WITH texts AS (SELECT rid, {_WORDS} AS w FROM piece),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM texts),
grams AS ({grams}),
counted AS (SELECT rid, gram, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY rid, gram),
hashed AS (SELECT gram, crc_bucket(gram) AS bucket FROM (SELECT DISTINCT gram FROM counted)),
by_bucket AS (SELECT rid, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (gram) GROUP BY rid, bucket),
by_text AS (SELECT rid, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS times, sum(n)::BIGINT AS n FROM by_bucket GROUP BY rid)
SELECT len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(times, []) AS times
FROM texts LEFT JOIN by_text USING (rid) ORDER BY rid"""


def _counter(order: int, buckets: int):
    def bucket(grams: pa.ChunkedArray) -> pa.Array:
        return pa.array([zlib.crc32(g.encode()) % buckets for g in grams.to_pylist()], pa.int32())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as con:
            con.create_function("crc_bucket", bucket, ["VARCHAR"], "INTEGER", type="arrow")
            for ids, texts in _pieces(batches):
                con.register("piece", pa.table({"rid": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
                n_words, n_features, held, times = con.sql(_counts_sql(order)).to_arrow_table().combine_chunks().columns
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                columns = [c.combine_chunks().cast(k) for c, k in zip((n_words, n_features, held, times), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_words", "n_features", "buckets", "times"])
                con.unregister("piece")

    return count


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of consecutive rows, some megabytes at a time."""
    for batch in batches:
        start, size, texts = 0, 0, []
        for i, text in enumerate(batch.column(1)):
            text = text.as_buffer().to_pybytes()
            texts.append(text.decode("utf-8", "replace"))
            size += len(text) + 16
            if size >= PIECE or i + 1 == len(batch):
                yield batch.column(0).slice(start, len(texts)), texts
                start, size, texts = i + 1, 0, []


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, buckets, times: each text's buckets, and how often each occurs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_features long, buckets array<int>, times array<long>"
    return stored(docs.select("doc_id", raw("text")).mapInArrow(_counter(order, buckets), out), "buckets")


def _merged(counts: DataFrame, name: str) -> DataFrame:
    """All texts' features by bucket."""
    each = counts.select(F.inline(F.arrays_zip("buckets", "times")))
    return each.groupBy("buckets").agg(F.sum("times").alias(name))


def gains(counts: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floored thousandths of the logarithm of the target's share over the documents' share, with one more
    feature in each bucket."""
    s, t = _merged(counts, "s"), _merged(target, "t")
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("buckets"))
    both = every.join(s, "buckets", "left").join(t, "buckets", "left").select("buckets", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    up = (F.col("t").cast("double") + 1) * float(sums["all_s"] + buckets)
    down = (F.col("s").cast("double") + 1) * float(sums["all_t"] + buckets)
    return both.select(F.col("buckets").alias("bucket"), F.floor(1000 * F.log(up / down)).alias("gain"))


def _draw(doc_id: Column, seed: str) -> Column:
    """A Gumbel draw in thousandths, from the first 32 bits of the hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scores(counts: DataFrame, gained: DataFrame, seed: str = SEED) -> DataFrame:
    """counts of bucket_counts -> doc_id, n_words, n_features, weight, score. The gains are one number a bucket."""
    by_bucket = [str(r["gain"]) for r in gained.orderBy("bucket").collect()]
    table = F.split(F.lit(",".join(by_bucket)), ",").cast("array<long>")
    each = F.zip_with("buckets", "times", lambda b, n: n * F.get(table, b))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x + y)
    weight = F.when(F.col("n_features") > 0, F.floor(total / F.col("n_features"))).otherwise(0)
    scored = counts.select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))
    return scored.withColumn("score", F.col("weight") + _draw(F.col("doc_id"), seed))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, 3 ... by score, then doc_id, for the share of documents that is drawn; else null.

    The scores above a document's are counted by a running sum over the histogram by score, whose rows are bounded by
    the range of scores; documents of one score are numbered by themselves.
    """
    long_enough = F.col("n_words") >= min_words
    by_score = stored(scored.where(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "histogram")
    drawn = (by_score.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = by_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above")).where(F.col("above") < drawn)
    least = above.agg(F.min("score")).first()[0]
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    may = long_enough & (F.col("score") >= least)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    rank = F.col("above") + F.row_number().over(order)
    top = scored.where(may).join(F.broadcast(above), "score").select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return top.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, target (text) -> doc_id, n_features, weight, score, rank of every document."""
    counts = bucket_counts(docs, order, buckets)
    wanted = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), order, buckets)
    scored = stored(scores(counts, gains(counts, wanted, buckets), seed), "scores")
    return ranked(scored, min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows; the checksum is worked out byte by byte from its polynomial.
SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT row_number() OVER () AS rid, true AS ours, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), false, NULL, text FROM benchmark),
words AS (
  SELECT rid, ours, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
grams AS (SELECT rid, ours, gram, count(*) AS n FROM (SELECT rid, ours, unnest(w) AS gram FROM words) GROUP BY ALL),
coded AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM grams)),
hashed AS (
  SELECT gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM coded, tab),
counts AS (SELECT rid, ours, bucket, sum(n) AS n FROM grams JOIN hashed USING (gram) GROUP BY ALL),
merged AS (SELECT bucket, coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS t FROM counts GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) + 10000 AS all_s, coalesce(sum(t), 0) + 10000 AS all_t FROM merged),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * all_s / ((s + 1) * all_t)))::BIGINT AS gain FROM merged, sums),
weights AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM counts JOIN gains USING (bucket) WHERE ours GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (rid) WHERE ours),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
         (SELECT count(*) FROM scored WHERE n_words >= 20) * 10 // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM placed
"""
