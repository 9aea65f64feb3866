"""Importance resampling against a plain version, with n-grams of two orders."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwork.llm import resampling
from tests.llm.brute import alnum
from tests.llm.conftest import clashing


def plain(docs, target, order, buckets, seed, min_words, percent):
    def features(t):
        w = alnum(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(alnum(text))))
    able = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0], x[1], x[2]))
    drawn = len(able) * percent // 100
    ranks = [(*x[:4], k + 1) for k, x in enumerate(able[:drawn])] + [(*x[:4], None) for x in able[drawn:]] + [(*x[:4], None) for x in out if x[4] < min_words]
    return sorted(ranks, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("order", "buckets", "percent"), [(1, 10_000, 10), (3, 50, 40), (2, 1, 100)])
def test_against_plain(spark, docs, edges, order, buckets, percent):
    target = [edges[10][1], None, "one two three", ""]
    want = plain([(r[0], r[1]) for r in edges], target, order, buckets, "7", 4, percent)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    assert rows(resampling.resample(clashing(docs), t, order, buckets, "7", 4, percent)) == want


def test_ties_and_empty(spark, docs, none):
    """Repeated rows tie and get ranks of their own; an empty target and empty documents are defined."""
    tied = spark.createDataFrame([(5, "a b c d e f")] * 6 + [(None, "a b c d e f")] * 6, "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    got = resampling.resample(tied, empty, min_words=1, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5, 6]
    assert resampling.resample(none, empty).count() == 0
    assert resampling.resample(docs, empty).where("rank IS NOT NULL").count() == docs.where(F.size(F.array_remove(F.split("text", r"[^\w]+"), "")) >= 20).count() // 10


def test_texts_are_counted_in_pieces(spark, docs, monkeypatch):
    whole = rows(resampling.bucket_counts(docs, 2, 100))
    from unittest import mock

    with mock.patch.object(resampling, "PIECE", 50):
        got = list(resampling._counter(2, 100)(iter(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary")).toArrow().to_batches())))
    assert sorted((tuple(r.values()) for b in got for r in b.to_pylist()), key=str) == whole
