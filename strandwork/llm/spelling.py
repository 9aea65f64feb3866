"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Words that are one edit apart and their lengths define where the index must be looked up: a word of L code points meets
words of L (one code point replaced) and of L + 1 (one inserted). An edit touches one half of the shorter word, so that
the other half stands unchanged at the same end: words go to a shard for each half, and a shard holds the words that
share it. A shard of more than SHARD words is split by the halves of the part that may differ, and so on; where one code
point may differ the alphabet bounds the shard. So no shard grows with the vocabulary, and no word is left out.

Within a shard each word's free part is cut into positional bigrams over its two neighbours. A word merges the posting
lists of its bigrams in a heap: postings of its own length at the same place, and of one more code point at the same
place or the next. One edit leaves at least max(length) - 1 of the bigrams of parts so padded: words that share fewer
are dropped, the rest is verified. The longest lists are not merged: a word that passes the filter must also stand in
one of the others, so they are only looked up. Pairs are not written: a shard returns each word's number of near words
and its best one, and these are added up by word.

A pair can meet in several shards; it counts in the one that the first difference leads to.

Defined results: null texts have no words; a null doc_id is written as nothing before the colon; repeated rows count as
often as they occur. Words are told apart by their code points; ties of n go to the smaller word in code-point order.
Columns besides doc_id and text are not read. An empty table has no words.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.common import raw, stored

MIN_LENGTH, MIN_COUNT = 6, 5
#: A form occurs at least so many times as often as the word.
RATIO = 5
#: One run of so many loses a code point, by its checksum.
DROPPED = 199
#: Words of a shard before it is split; distinct words that a task counts before it passes them on.
SHARD, HELD = 3_000, 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The contract's letters, less A-Z.
_LETTERS = "a-zÀ-ÿ"


def text_words(doc_id: object, text: bytes, min_length: int = MIN_LENGTH, dropped: int = DROPPED) -> Counter:
    """Occurrences of the words of one text, after the checksum's deletions."""
    runs = Counter(re.findall(f"[{_LETTERS}]{{{min_length},}}", text.translate(_LOWER).decode("utf-8", "replace")))
    start = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    out: Counter = Counter()
    for run, k in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % dropped == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        out[run] += k
    return out


def _counter(min_length: int, dropped: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        sent = lambda: pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, k in text_words(doc_id, text.as_buffer().to_pybytes(), min_length, dropped).items():
                    held[word] += k
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        yield sent()

    return count


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, dropped: int = DROPPED) -> DataFrame:
    """docs (doc_id, text) -> word, n: the words with enough code points and occurrences."""
    counted = docs.select("doc_id", raw("text")).mapInArrow(_counter(min_length, dropped), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _key(ahead: Column, behind: Column) -> Column:
    """The shard of words with a base length whose first `ahead` and last `behind` code points are equal."""
    w = F.col("word")
    return F.xxhash64("base", ahead, behind, F.substr(w, F.lit(1), ahead), F.when(behind > 0, F.substr(w, F.length(w) - behind + 1, behind)).otherwise(""))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, base, ahead, behind) twice: one half of the free part joins what is fixed before or behind it."""
    half = F.expr("(base - ahead - behind) div 2").cast("int")
    left = F.struct((F.col("ahead") + half).alias("ahead"), F.col("behind").alias("behind"))
    right = F.struct(F.col("ahead").alias("ahead"), (F.col("base") - F.col("ahead") - half).alias("behind"))
    rows = rows.select("word", "n", "base", F.explode(F.array(left, right)).alias("p")).select("word", "n", "base", "p.ahead", "p.behind")
    return rows.withColumn("key", _key(F.col("ahead"), F.col("behind")))


def shards(words: DataFrame, limit: int = SHARD) -> DataFrame:
    """words (word, n) -> word, n, base, ahead, behind, key: the shards in which words meet all that may be near.

    Rounds split the shards that are too large; a round counts rows by shard, and the driver sees whether one is left.
    """
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("base")).where("base > 1")
    rows = _halved(whole.select("*", F.lit(0).alias("ahead"), F.lit(0).alias("behind")))
    done = None
    while True:
        large = rows.where("base - ahead - behind > 1").groupBy("key").count().where(F.col("count") > limit).select("key")
        large = stored(large, "large")
        if not large.head(1):
            return rows if done is None else done.unionByName(rows)
        kept, again = rows.join(large, "key", "left_anti"), rows.join(large, "key", "left_semi")
        stay = again.where("base - ahead - behind <= 1")
        done = kept.unionByName(stay) if done is None else done.unionByName(kept).unionByName(stay)
        rows = stored(_halved(again.where("base - ahead - behind > 1").select("word", "n", "base", "ahead", "behind")), "shards")


def _one_edit(s: str, t: str) -> int | None:
    """Where t, of the same length or one more, first differs from s if by exactly one edit."""
    n, at = len(s), 0
    while at < n and s[at] == t[at]:
        at += 1
    if len(t) > n:
        return at if s[at:] == t[at + 1 :] else None
    return at if at < n and s[at + 1 :] == t[at + 1 :] else None


def _grams(word: str, ahead: int, behind: int) -> list[str]:
    """Bigrams of the free part, with the fixed code points beside it."""
    end = len(word) - behind
    part = (word[ahead - 1] if ahead else "") + word[ahead:end] + (word[end] if behind else "")
    part = part if ahead else "\n" + part
    part = part if behind else part + "\n"
    return [part[i : i + 2] for i in range(len(part) - 1)]


def _candidates(lists: list[list[int]], least: int) -> list[int]:
    """Members that stand in at least so many of the sorted posting lists."""
    lists.sort(key=len)
    few = len(lists) - max(least, 1) + 1
    if few <= 0:
        return []
    out = []
    for member, same in groupby(merge(*lists[:few])):
        seen, left = sum(1 for _ in same), len(lists) - few
        for more in lists[few:]:
            if seen + left < least:
                break
            i = bisect_left(more, member)
            seen += i < len(more) and more[i] == member
            left -= 1
        if seen >= least:
            out.append(member)
    return out


def near_in_shard(words: list[tuple[str, int]], base: int, ahead: int, behind: int) -> dict[int, list]:
    """Members (word, n) of a shard -> member: [near words, largest n negated, the smallest such word]."""
    index: tuple[dict, dict] = defaultdict(list), defaultdict(list)
    grams = [_grams(w, ahead, behind) for w, _ in words]
    for i, (w, _) in enumerate(words):
        for place, g in enumerate(grams[i]):
            index[len(w) - base][g, place].append(i)
    free = base - ahead - behind
    out: dict[int, list] = {}

    def link(i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            found = out.setdefault(a, [0, 0, ""])
            found[0] += 1
            found[1:] = min(found[1:], [-words[b][1], words[b][0]])

    same, longer = index
    own = [i for i, (w, _) in enumerate(words) if len(w) == base]
    for k, i in enumerate(own):
        w = words[i][0]
        if free > 1:
            lists = [same[g, place] for place, g in enumerate(grams[i])]
            found = _candidates([x[bisect_right(x, i) :] for x in lists], free - 1)
        else:  # one replaced code point leaves no bigram; such a shard has at most one word a letter
            found = own[k + 1 :]
        if longer:
            both = [x for place, g in enumerate(grams[i]) for x in (longer.get((g, place)), longer.get((g, place + 1))) if x]
            found = found + _candidates(both, free)
        for j in found:
            t = words[j][0]
            at = _one_edit(w, t)
            if at is not None and w[:ahead] == t[:ahead] and (not behind or (w[-behind:] == t[-behind:] and at < base - behind)):
                link(i, j)
    return out


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> each word's near words in the shard, counted, and the best."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list = []
    for (_, base, ahead, behind), members in groupby(rows, key=lambda r: r[:4]):
        words = [(w, n) for *_, w, n in members]
        if len(words) > 1:
            out += [(words[i][0], k, -least, best) for i, (k, least, best) in near_in_shard(words, base, ahead, behind).items()]
        if len(out) > 50_000:
            yield _sent(out)
            out = []
    yield _sent(out)


def _sent(rows: list) -> pa.RecordBatch:
    word, k, n, best = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame, limit: int = SHARD) -> DataFrame:
    """words (word, n) -> word, n_near, form, form_n for words with near words; form: the near word of largest n."""
    rows = shards(words, limit).select("key", "base", "ahead", "behind", "word", "n")
    dealt = rows.repartition("key").sortWithinPartitions("key", "base", "ahead", "behind", "word")
    found = dealt.mapInArrow(_near, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def variant_groups(docs: DataFrame, ratio: int = RATIO, limit: int = SHARD) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n.

    Each step to a form multiplies n by the ratio, so that the largest n bounds the steps to a root, and doubling paths
    takes the logarithm of that many joins.
    """
    words = stored(vocabulary(docs), "words")
    near = near_words(words, limit)
    enough = F.col("form_n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    formed = stored(formed, "formed")
    most = words.agg(F.max("n")).first()[0] or 0
    steps = max(1, int(math.log(max(most, 1), ratio)))
    to = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) + 1):
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = stored(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows by deletion neighbourhoods; the checksum is worked out byte by byte from its polynomial.
SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{6,}')) AS run FROM documents)
  GROUP BY ALL),
bytes AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, tab),
words AS (
  SELECT word, sum(k)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest, CASE WHEN w.same THEN i END AS at
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) a, (VALUES (true), (false)) w(same)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word WHERE a.at IS NULL
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word WHERE a.at IS NULL),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
path AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM formed
  UNION ALL
  SELECT p.word, coalesce(f.form, p.root), f.form IS NULL FROM path p JOIN formed f ON f.word = p.root WHERE NOT p.ended)
SELECT f.word, f.form, p.root, f.n, f.n_near, f.form_n FROM formed f JOIN path p ON p.word = f.word AND p.ended
"""
