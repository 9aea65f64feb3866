"""Spelling variants against all pairs compared in plain loops."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandwork.llm import spelling
from tests.llm.conftest import clashing


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """word -> (form, root, n, n_near, form_n)."""
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


@pytest.mark.parametrize("limit", [2, 40, 3000])
def test_against_all_pairs(spark, limit):
    """Few letters, so that words are near, shards are split to the end, and repeated letters make a pair meet twice."""
    rng = random.Random(limit)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[w] = rng.choice([5, 6, 25, 30, 125, 700])
    words |= {"a" * k: 5 ** (k - 4) for k in range(6, 11)} | {"b" * 400: 9, "b" * 401: 50, "b" * 200 + "a" + "b" * 199: 5}
    docs = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    count = Counter()
    for i, t in docs:
        for w in t.split():
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    want = plain({w: n for w, n in count.items() if len(w) >= 6 and n >= 5})
    assert rows(spelling.variant_groups(clashing(spark.createDataFrame(docs, "doc_id long, text string")), limit=limit)) == want


def test_words_of_a_text():
    assert spelling.text_words(1, "ABCdef, abcdef ÉTÉÉÉÉ été×÷éé ab3cdefgh".encode(), dropped=10**12) == {"abcdef": 2, "ÉTÉÉÉÉ".replace("T", "t"): 1, "été×÷éé": 1, "cdefgh": 1}
    assert spelling.text_words(None, b"") == {}
    assert spelling.text_words(None, b"abcdefg", dropped=1) == Counter(["abcdefg"[: (h := zlib.crc32(b":abcdefg")) % 7] + "abcdefg"[h % 7 + 1 :]])
    assert spelling.text_words(None, b"abcdef", dropped=1) == {}


def test_filter_bound():
    """A pair that is one edit apart is always among the candidates; the bound is met with equality by some pair."""
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(4, 8)))
        at = rng.randrange(len(s))
        t = s[:at] + rng.choice("xabc") + s[at + rng.randrange(2) :]
        if s == t:
            continue
        found = spelling.near_in_shard([(w, 1) for w in sorted((s, t))], len(s), 0, 0)
        assert (found != {}) == one_edit(s, t)


def test_edges(spark, none, docs):
    assert spelling.variant_groups(none).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, None), (2, "")], "doc_id long, text string")
    assert spelling.variant_groups(nulls).count() == 0
    twice = docs.unionAll(docs)
    n = spelling.vocabulary(docs, min_count=1).agg(F.sum("n")).first()[0]
    assert spelling.vocabulary(twice, min_count=1).agg(F.sum("n")).first()[0] == 2 * n > 0
