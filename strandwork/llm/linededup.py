"""Line deduplication by pairwise alignment.

A run is the fewest consecutive lines from a line on, or up to a line, that have ``block_words`` words. A line stands in a
common block of enough words exactly if it stands in a common run, however short the lines are. Documents meet through their runs' hashes: the
earliest document that has a run owns it, so each shared run gives every other holder one partner and no group is
expanded into pairs. A pair's line sequences are aligned by a patience diff, and common blocks with enough words are
deleted from the later document. What an alignment leaves, because it is moved or has no unique line, is aligned again by
its runs, until no common run is left. So a line goes exactly if it stands in a block of enough words that any earlier
document has.

No line or run is left out for being common: a common one has one owner like any other, so the work stays linear in its
holders. Were partners chosen by rare runs only, blocks of common lines would stay.

Defined results: order is by doc_id, nulls last, then by the text's hash; equal rows (same id, same text) are the same
document, get the same output and delete nothing from each other. Null and empty texts have no lines and come back
unchanged. Deleted lines go with their line break; other lines keep order and bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import fresh, mix64, stored, whole

BLOCK_WORDS = 12
#: Lines hashed at once.
CHUNK = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_table = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def patience_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, length) of two sequences.

    Within a range, elements that occur once on both sides are anchors; the longest increasing run of anchors is kept,
    each anchor grows both ways, and the gaps between are aligned again. Ranges without anchors match equal ends only.
    """
    if len(a) == len(b) and np.array_equal(a, b):
        return [(0, 0, len(a))] if len(a) else []
    a, b = a.tolist(), b.tolist()
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        n = 0
        while al + n < ah and bl + n < bh and a[al + n] == b[bl + n]:
            n += 1
        if n:
            found.append((al, bl, n))
            al, bl = al + n, bl + n
        n = 0
        while ah - n > al and bh - n > bl and a[ah - n - 1] == b[bh - n - 1]:
            n += 1
        if n:
            found.append((ah - n, bh - n, n))
            ah, bh = ah - n, bh - n
        if al >= ah or bl >= bh:
            continue
        ca, cb = Counter(a[al:ah]), Counter(b[bl:bh])
        at_a = {x: i for i, x in enumerate(a[al:ah], al) if ca[x] == 1}
        pairs = [(at_a[x], j) for j, x in enumerate(b[bl:bh], bl) if cb[x] == 1 and x in at_a]
        if not pairs:
            continue
        tails, ends, back = [], [], []
        for k, (i, _) in enumerate(pairs):
            p = bisect_left(tails, i)
            if p == len(tails):
                tails.append(i)
                ends.append(k)
            else:
                tails[p], ends[p] = i, k
            back.append(ends[p - 1] if p else -1)
        k, run = ends[-1], []
        while k >= 0:
            run.append(pairs[k])
            k = back[k]
        pa_, pb_ = al, bl
        for i, j in reversed(run):
            if i < pa_ or j < pb_:
                continue  # swallowed by the growth of the anchor before
            s = 0
            while i - s > pa_ and j - s > pb_ and a[i - s - 1] == b[j - s - 1]:
                s += 1
            e = 1
            while i + e < ah and j + e < bh and a[i + e] == b[j + e]:
                e += 1
            found.append((i - s, j - s, s + e))
            todo.append((pa_, i - s, pb_, j - s))
            pa_, pb_ = i + e, j + e
        todo.append((pa_, ah, pb_, bh))
    found.sort(key=lambda x: x[1])
    joined: list[tuple[int, int, int]] = []
    for i, j, n in found:
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers from 0 to n and their inverses; a table grows as needed."""
    if len(_table[0]) <= n:
        size = max(2 * n, 1 << 12)
        for k, x in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _table[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, np.uint64(x)))])
    return _table[0][: n + 1], _table[1][: n + 1]


def runs(lines: np.ndarray, words: np.ndarray, least: int, first: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end (exclusive) and hash of the shortest run with enough words from each line on, and up to each line.

    first, last: where each line's document begins and ends (exclusive).
    """
    size = np.arange(len(lines))
    n = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    power, back = _powers(len(lines))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(lines.astype(np.int64).view(np.uint64)) * power[:-1])])
    out = []
    for start, end in ((size, np.searchsorted(n, n[:-1] + least, "left")), (np.searchsorted(n, n[1:] - least, "right") - 1, size + 1)):
        good = (start >= first) & (end <= last)
        start, end = start[good], end[good]
        out.append((start, end, mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64)))
    return out


def _starts(lines: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of one document's runs of both kinds."""
    both = runs(lines, words, least, 0, len(lines))
    return tuple(np.concatenate(x) for x in zip(*both, strict=True))


def aligned(a: np.ndarray, b: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Which lines of b stand in common blocks of enough words of alignments with a; words are those of b's lines.

    The first alignment is that of the lines. Blocks that are moved, or of lines that aren't unique, are left over by it,
    so what is left is aligned again, by its runs of enough words: each distinct run that both have is an element, in the
    order of its first places, and stands for all its places in b. The alignments take turns in following a downwards and
    upwards, each takes at least one element, and the last leaves no common run.
    """
    cut = np.zeros(len(b), bool)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    for _, j, n in patience_blocks(a, b):
        if total[j + n] - total[j] >= least:
            cut[j : j + n] = True
    if cut.all() or set(a.tolist()).isdisjoint(b[~cut].tolist()):
        return cut
    known, at_b = np.unique(b, return_index=True)
    at = np.minimum(np.searchsorted(known, a), len(known) - 1)
    theirs = np.where(known[at] == a, words[at_b[at]], 0)  # runs over lines that b hasn't are not common anyway
    (start, end, key), (start_a, _, key_a) = _starts(b, words, least), _starts(a, theirs, least)
    upto = np.concatenate([[0], np.cumsum(~cut)])
    left = np.isin(key, key_a) & (upto[end] > upto[start])  # runs that both have and that have a line left
    start, end, key = start[left], end[left], key[left]
    first_a = dict(zip(key_a[order := np.lexsort((-start_a,))].tolist(), start_a[order].tolist(), strict=True))
    down = True
    while len(key):
        order = np.argsort(start, kind="stable")
        ours = np.array(list(dict.fromkeys(key[order].tolist())), np.int64)
        others = np.array(sorted(ours.tolist(), key=first_a.__getitem__, reverse=not down), np.int64)
        taken = np.concatenate([ours[j : j + n] for _, j, n in patience_blocks(others, ours)])  # at least one: all are in both
        go = np.isin(key, taken)
        depth = np.zeros(len(b) + 1, np.int64)
        np.add.at(depth, start[go], 1)
        np.add.at(depth, end[go], -1)
        cut |= np.cumsum(depth[:-1]) > 0
        start, end, key = start[~go], end[~go], key[~go]
        down = not down
    return cut


@F.arrow_udf(T.ArrayType(T.LongType()))
def _runs(lines: pa.Array, words: pa.Array, least: pa.Array) -> pa.Array:
    """Hashes of the runs of both kinds: whichever lines an earlier document repeats, their runs have owners."""
    at, h, w = np.asarray(lines.offsets), np.asarray(lines.values), np.asarray(words.values)
    shift = int(words.offsets[0].as_py()) - int(at[0]) if len(at) else 0
    keys, counts, i = [], [], 0
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)  # documents of at most so many lines, or one
        a, b, sizes = at[i], at[j], np.diff(at[i : j + 1])
        of = np.repeat(np.arange(j - i), sizes)
        first, last = np.repeat(at[i:j] - a, sizes), np.repeat(at[i + 1 : j + 1] - a, sizes)
        (start, end, key), (start_, end_, key_) = runs(h[a:b], w[a + shift : b + shift], least[0].as_py(), first, last)
        ends = np.zeros(b - a, np.int64)
        ends[start] = end
        new = ends[start_] != end_  # not one of the first kind too
        doc = np.concatenate([of[start], of[start_[new]]])
        keys.append(np.concatenate([key, key_[new]])[np.argsort(doc, kind="stable")])
        counts.append(np.bincount(doc, minlength=j - i))
        i = j
    offsets = np.concatenate([[0], *map(np.cumsum, [np.concatenate(counts)] if counts else [])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _cut(theirs: pa.Array, ours: pa.Array, words: pa.Array, least: pa.Array) -> pa.Array:
    """Line numbers of the later document inside common blocks with enough words."""
    out = []
    for a, b, w, n in zip(theirs, ours, words, least, strict=True):
        cut = aligned(np.asarray(a.values), np.asarray(b.values), np.asarray(w.values), n.as_py())
        out.append(np.flatnonzero(cut).astype(np.int32))
    return pa.array(out, pa.list_(pa.int32()))


def cuts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text_key and the sorted line numbers (from 0) to delete, for documents with any.

    docs: doc_id and text. Only line hashes and word counts are shuffled, never texts.
    """
    lines = F.split(whole("text"), "\n", -1)
    split = docs.select(
        "doc_id",
        F.xxhash64(whole("text")).alias("text_key"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(lines, lambda x: F.size(F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda y: y != ""))).alias("words"),
    )
    sides = stored(split.withColumn("runs", _runs("hashes", "words", F.lit(block_words))), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key").alias("doc")
    held = sides.select(order, F.explode("runs").alias("run"))
    owners = held.groupBy("run").agg(F.min("doc").alias("owner"), F.max("doc").alias("final")).where("owner < final").select("run", "owner")
    owners = stored(owners, "owners")  # read afresh, both sides of the join are dealt out for it, and a hot run can be split
    pairs = held.join(owners, "run").where("owner < doc").select("owner", "doc").distinct()
    # equal rows would repeat a side; one of each is enough
    side = sides.select(order, "hashes", "words").dropDuplicates(["doc"])
    cut = (
        pairs.join(side.select(F.col("doc").alias("owner"), F.col("hashes").alias("theirs")), "owner")
        .join(side, "doc")
        .select("doc", F.explode(_cut("theirs", "hashes", "words", F.lit(block_words))).alias("at"))
    )
    return cut.groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("at")).select("doc.doc_id", "doc.text_key", "at")


def _without(lines: Column, at: Column) -> Column:
    """The lines less those at the sorted places: the stretches between neighbouring places, one after the other."""
    bounds = lambda own: F.concat(F.array(F.lit(-1)), at, F.array(F.size(own)))
    stretch = lambda own: lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), F.size(b) - 1), lambda x, y: F.slice(own, x + 2, y - x - 1))
    return F.transform(F.array(lines), lambda own: F.flatten(F.transform(F.array(bounds(own)), stretch(own))[0]))[0]


def dedup_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """docs with the new text, its number of lines and of deleted lines; and the names of these three columns."""
    name: dict[str, str] = {}
    for want in ("new_text", "n_lines", "n_removed", "cut_id", "cut_key", "at", "row_key"):
        name[want] = fresh([*docs.columns, *name.values()], want)
    found = cuts(docs.select("doc_id", "text"), block_words).toDF(name["cut_id"], name["cut_key"], name["at"])
    lines = F.split(whole("text"), "\n", -1)
    keyed = docs.withColumn(name["row_key"], F.xxhash64(whole("text")))
    same = F.col("doc_id").eqNullSafe(F.col(name["cut_id"])) & (F.col(name["row_key"]) == F.col(name["cut_key"]))
    at = F.col(name["at"])
    left = F.array_join(_without(lines, at), "\n")
    out = (
        keyed.join(found, same, "left")
        .withColumn(name["new_text"], F.when(at.isNull(), F.col("text")).otherwise(left))
        .withColumn(name["n_lines"], F.when(whole("text") == "", 0).otherwise(F.size(lines)).cast("long"))
        .withColumn(name["n_removed"], F.coalesce(F.size(at), F.lit(0)).cast("long"))
        .drop(name["cut_id"], name["cut_key"], name["at"], name["row_key"])
    )
    return out, name


def without_repeats(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents with the repeated blocks cut out; n_chars follows the text.

    A document that had words and lost all of them was a copy, and goes.
    """
    out, name = dedup_lines(docs, block_words)
    new = F.col(name["new_text"])
    gone = (F.col(name["n_removed"]) > 0) & ~new.rlike(r"[^\x20\x09-\x0D]")
    cols = []
    for c in docs.columns:
        col = F.col(f"`{c}`")
        if c == "text":
            col = new
        elif c == "n_chars":
            col = F.when(F.col(name["n_removed"]) > 0, F.length(new).cast(docs.schema[c].dataType)).otherwise(col)
        cols.append(col.alias(c))
    return out.where(~F.coalesce(gone, F.lit(False))).select(cols)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the new text's sha256 for every document."""
    out, name = dedup_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col(name["n_lines"]).alias("n_lines"),
        F.col(name["n_removed"]).alias("n_removed"),
        F.length(whole(name["new_text"])).cast("long").alias("n_chars_left"),
        F.sha2(whole(name["new_text"]), 256).alias("text_sha256"),
    )


#: The same lines without owners or alignment: those in a run of enough words that any earlier document has.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY doc_id NULLS LAST, coalesce(text, '')) AS doc, doc_id, coalesce(text, '') AS text,
         string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT rid, doc, unnest(range(1, len(lines) + 1)) AS i, len(regexp_extract_all(unnest(lines), '[^\x20\x09-\x0D]+')) AS words FROM d),
c AS (SELECT rid, doc, i, words, sum(words) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS upto FROM l),
ends AS (SELECT rid, upto, min(i) AS i FROM c GROUP BY ALL),
starts AS (SELECT rid, upto - words AS before, max(i) AS i FROM c GROUP BY ALL),
r AS (
  SELECT c.rid, doc, c.i AS low, e.i AS high FROM c ASOF JOIN ends e ON c.rid = e.rid AND c.upto - c.words + 12 <= e.upto
  UNION
  SELECT c.rid, doc, s.i, c.i FROM c ASOF JOIN starts s ON c.rid = s.rid AND c.upto - 12 >= s.before),
k AS (SELECT r.rid, r.doc, low, high, md5(array_to_string(list_slice(lines, low, high), chr(10))) AS run FROM r JOIN d ON d.rid = r.rid),
o AS (SELECT run, min(doc) AS owner FROM k GROUP BY run),
g AS (SELECT rid, list(DISTINCT i) AS gone FROM (SELECT rid, unnest(range(low, high + 1)) AS i FROM k JOIN o ON o.run = k.run AND o.owner < k.doc) GROUP BY rid),
n AS (
  SELECT doc_id, text, lines, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS new_text
  FROM d LEFT JOIN g ON g.rid = d.rid)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(lines) END AS n_lines, n_removed, length(new_text) AS n_chars_left, sha256(new_text) AS text_sha256
FROM n
"""
