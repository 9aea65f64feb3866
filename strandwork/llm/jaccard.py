"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document's set has its distinct word shingles. Sizes fall into bands; for a band with largest size u the universe
of shingles is hashed into m segments, and a set's subset in a segment is one signature. Two sets of the band that
reach the similarity differ in at most H = (|x| + |y|)(1 - t) / (1 + t) shingles, each of which spoils one segment, so
they agree in at least m - H segments. Sets of the next band sign for this one too.

Empty segments make no signature and very common ones prove nothing, so each set has a margin: its non-empty segments
less H. While fewer than that many of its signatures are common, it shares an uncommon signature with every set that it
links with. The allocation of segments weighs signatures against the chance of a set without a margin; such a set
pays for one-deletion neighbourhoods of its segments and for single shingles besides, which makes up for it.

Of the signatures that a set shares with others, only the rarest are followed, as many as its margin lets a linked set
miss, and one more: in the order of their holders' number, the first that two linked sets have in common is among these
for both. A set that shares fewer signatures than its margin is done. So a passage brings together only documents that
have little else of their own.

Holders of a signature are not expanded into pairs at first: each set is paired with the holder that shares most with
it, pairs are verified on the whole sets, and links become components. Only holders of a signature that are then still
in different components are compared, less the sets that have more shingles of their own, which no other such set has,
than a link allows: as pairs where the holders are few, so that each makes a bounded number of them, else in blocks,
those outside the largest component against all. So no link between different texts is lost.

Signatures travel packed: a task sorts those of some megabytes of text by bucket and sends one row a bucket (4 bytes a
signature, 2 for its place among the row's documents). They only propose pairs, so their truncation costs a few needless
verifications. Shingles are compared as 64-bit hashes, equal sets as 128-bit hashes of those.

Defined results: null and empty texts and texts without words have empty sets and link with nothing, so they are their
own component; a text with fewer words than a shingle is one shingle. Rows with equal ids, or none, are told apart by
their texts' hashes and sets; a null id never is the smallest id of a component unless there is no other. Repeated rows
share a component. Columns besides doc_id and text are not read; one_of_each keeps them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import fresh, mix64, raw, stored, word_hashes
from strandwork.llm.components import components

WIDTH = 5
#: Similarity as a fraction of integers, so that the bound is exact.
NUM, DEN = 3, 4
#: Holders of a signature beyond which they are compared in blocks, not as pairs; ids or pairs that may be broadcast; signatures a bucket.
COMMON, MAX_BROADCAST, BUCKET = 16, 250_000, 2_000_000
#: A block's minor members, members, and shingles.
MINORS, MEMBERS, BLOCK_WORDS = 512, 1024, 1 << 20
FLUSH = 8 << 20
#: Shingles that a batch of them holds, but for those of its last set.
BATCH = 1 << 17

_U = np.uint64


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()  # of bytes: A-Z only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    size = min(n, width)
    code = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        code = code * _U(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k]
    return np.unique(mix64(code))


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType())]))
def _node(texts: pa.Array) -> pa.Array:
    sets = [shingles(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary())], names=["n", "key"])


_node = _node.asNondeterministic()


def _parities(s: np.ndarray) -> bytes:
    """Whether each of 2 to 4 times as many parts of the universe as the set has shingles holds an odd number of them."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


@F.arrow_udf(T.StructType([T.StructField(x, T.BinaryType()) for x in ("key", "shingles", "parities")]))
def _set_bytes(texts: pa.Array) -> pa.Array:
    sets = [shingles(t) for t in texts.to_pylist()]
    cols = [[f(s) for s in sets] for f in (_key, np.ndarray.tobytes, _parities)]
    return pa.StructArray.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["key", "shingles", "parities"])


def _folded(parities: bytes, size: int) -> np.ndarray:
    """The parities of fewer parts: the parts with the same lower bits of their number, joined."""
    return np.bitwise_xor.reduce(np.frombuffer(parities, np.uint8).reshape(-1, size), axis=0)


@F.arrow_udf(T.LongType())
def _least_difference(left: pa.Array, right: pa.Array) -> pa.Array:
    """What two sets differ in at least: each shingle that only one has changes one parity."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
        size = min(len(a), len(b))
        out.append(int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()))
    return pa.array(out, pa.int64())


_set_bytes = _set_bytes.asNondeterministic()  # else a later filter takes it below the join, to every text


@F.arrow_udf(T.BooleanType())
def _linked(left: pa.Array, right: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
        both = np.concatenate([x, y])
        both.sort(kind="stable")  # two sorted runs
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
    return pa.array(out, pa.bool_())


def segments_for(u: int) -> int:
    """Segments of a band with largest size u: the cheapest number of signatures, a set without a margin costing its
    deletion neighbourhoods, its single shingles and the pairs that they propose."""

    def cost(m: int) -> float:
        empty = math.exp(-u / m)
        mean, var = m * (1 - empty), max(1e-9, m * empty * (1 - (1 + u / m) * empty))
        short = 0.5 * math.erfc((mean - u // 3 - 0.5) / math.sqrt(2 * var))
        return m * (1 - empty) + short * 200 * u

    return min(range(u // 3 + 2, 4 * u + 2, max(1, u // 50)), key=cost)


def bands_to(largest: int) -> list[tuple[int, int, int]]:
    """(least size, largest size, segments); sets that link are in the same band or in neighbours."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * 1.6))
        out.append((low, high, segments_for(high)))
        low = high + 1
    return out


def _sign(sets: list[np.ndarray], bands, first_bucket, n_buckets) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed signatures) of some sets."""
    refs = np.array([int.from_bytes(_key(s)[:8], "big") for s in sets], np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    low, high, seg = (np.array(x, np.int64) for x in zip(*bands, strict=True))
    own = np.searchsorted(low, n, "right") - 1
    for back in (0, 1):
        band = own - back
        use = np.flatnonzero((band >= 0) & ((back == 0) | (NUM * n <= DEN * high[np.maximum(band, 0)])))
        if not len(use):
            continue
        b = band[use]
        all_s = np.concatenate([sets[i] for i in use])
        d = np.repeat(np.arange(len(use)), n[use])
        s_of = ((all_s >> _U(32)) * seg[b].astype(np.uint64)[d]) >> _U(32)  # rises with the hash, so subsets are runs
        start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s_of[1:] != s_of[:-1])]))
        mixed = mix64(all_s)
        total, at, place = np.add.reduceat(mixed, start), d[start], s_of[start]
        salt = b.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        sig = mix64(total ^ (salt[at] + place * _U(0xA0761D6478BD642F)))
        limit = n[use] // 3 if back == 0 else 2 * n[use] // 7
        margin = np.bincount(at, minlength=len(use)) - limit
        for i in np.flatnonzero(margin <= 0):
            mine = np.flatnonzero(d == i)
            ends = np.searchsorted(s_of[mine], s_of[mine], "left"), np.searchsorted(s_of[mine], s_of[mine], "right")
            whole = np.add.reduceat(mixed[mine], np.unique(ends[0]))[np.unique(ends[0], return_inverse=True)[1]]
            many = ends[1] - ends[0] > 1
            gone = mix64((whole - mixed[mine])[many] ^ (salt[i] + s_of[mine][many] * _U(0xA0761D6478BD642F)))
            single = mix64(mixed[mine] ^ salt[i] ^ _U(0x5851F42D4C957F2D))
            sig = np.concatenate([sig, gone, single])
            at = np.concatenate([at, np.full(len(gone) + len(single), i)])
        bucket = first_bucket[b][at] + (((sig >> _U(40)) * n_buckets[b].astype(np.uint64)[at]) >> _U(24)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, at, sig = bucket[order], at[order], sig[order].astype(np.uint32)
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            held, where = np.unique(at[x:y], return_inverse=True)
            head = np.array([len(held), y - x], np.uint32)
            yield int(bucket[x]), b"".join(
                z.tobytes()
                for z in (head, refs[use[held]], np.clip(margin[held], -1, 30000).astype(np.int16), where.astype(np.uint16), sig[x:y])
            )


def _packer(bands, first_bucket, n_buckets):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        size = 0

        def flush():
            rows = list(_sign(list(sets.values()), bands, first_bucket, n_buckets)) if sets else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for v in batch.column(0):
                s = shingles(v.as_buffer().to_pybytes())
                if len(s):
                    sets[_key(s)] = s  # copies within a flush sign once
                    size += 8 * len(s)
                if size > FLUSH or len(sets) > 30_000:
                    yield from flush()
                    sets.clear()
                    size = 0
        yield from flush()

    return pack


_FOUND = "gid long, ref long, x long, size int, times int, band int, margin int"


def _finder(first_bucket):
    """All signatures of a bucket -> a row for each holder ``ref`` of each group of signatures with the same ``size``
    holders: how many signatures it stands for, the holder's margin, and ``x``, the other holder with most company."""

    def find(table: pa.Table) -> pa.Table:
        band = int(np.searchsorted(first_bucket, table.column("bucket")[0].as_py(), "right") - 1)
        sigs, refs, margins = [], [], []
        for v in table.column("packed"):
            raw_ = v.as_buffer().to_pybytes()
            docs, n = np.frombuffer(raw_, np.uint32, 2).tolist()
            p = 8
            r = np.frombuffer(raw_, np.uint64, docs, p)
            m = np.frombuffer(raw_, np.int16, docs, p := p + 8 * docs)
            w = np.frombuffer(raw_, np.uint16, n, p := p + 2 * docs)
            sigs.append(np.frombuffer(raw_, np.uint32, n, p + 2 * n))
            refs.append(r[w])
            margins.append(m[w])
        sig, ref, margin = np.concatenate(sigs), np.concatenate(refs), np.concatenate(margins)
        order = np.argsort(sig)
        s = sig[order]
        same = np.concatenate([[False], s[1:] == s[:-1]])
        twice = order[same | np.concatenate([same[1:], [False]])]
        order = twice[np.lexsort((ref[twice], sig[twice]))]
        sig, ref, margin = sig[order], ref[order], margin[order]
        once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])])[: len(sig)]
        sig, ref, margin = sig[once], ref[once], margin[once]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)])
        size = np.diff(np.append(start, len(sig)))
        # one signature stands for all with the same holders
        gid = np.add.reduceat(mix64(ref), start) if len(start) else np.empty(0, np.uint64)
        gid = mix64(gid ^ (size.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(band)))
        _, lead, times = np.unique(gid, return_index=True, return_counts=True)
        lead, times = lead[size[lead] > 1], times[size[lead] > 1]
        length = size[lead]
        at = np.repeat(start[lead] - np.cumsum(length) + length, length) + np.arange(length.sum())
        group = np.repeat(np.arange(len(lead)), length)
        held = ref[at]
        who, back = np.unique(held, return_inverse=True)
        company = np.bincount(back, (length * times)[group], len(who))[back] if len(who) else np.empty(0)
        by = np.lexsort((held, -company, group))  # each group's holders, the one with most company first
        first = np.cumsum(length) - length
        x = held[by][first][group]
        x = np.where(x == held, held[by][first + 1][group], x)
        cols = (gid[lead][group].view(np.int64), held.view(np.int64), x.view(np.int64), length[group].astype(np.int32), times[group].astype(np.int32), np.full(len(at), band, np.int32), margin[at].astype(np.int32))
        return pa.table([pa.array(c) for c in cols], names=["gid", "ref", "x", "size", "times", "band", "margin"])

    return find


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of refs -> linked pairs (a, b) of keys. A ref that two keys share brings both, and both are verified."""
    size = sets.select("ref", "key", "n", "parities")
    near = (
        pairs.join(size.toDF("a", "ka", "na", "pa"), "a")
        .join(size.toDF("b", "kb", "nb", "pb"), "b")
        .where((NUM * F.greatest("na", "nb") <= DEN * F.least("na", "nb")) & (F.col("ka") != F.col("kb")))
    )
    # nearly all pairs that don't link go here, before any set moves
    near = stored(near.where((NUM + DEN) * _least_difference("pa", "pb") <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("ka", "kb"), "near")
    whole = sets.select("key", "shingles")
    if near.count() <= MAX_BROADCAST:
        near = F.broadcast(near)
    return (
        whole.toDF("kb", "sb")
        .join(near, "kb")
        .join(whole.toDF("ka", "sa"), "ka")
        .where(_linked("sa", "sb"))
        .select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    )


def _sets_of(refs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """ref, key, n, shingles and parities of the classes with these refs, from the text of one document each."""
    need = stored(classes.join(refs, "ref", "left_semi").select("ref", "key", "n", F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("hash")), "needed")
    if need.count() <= MAX_BROADCAST:
        need = F.broadcast(need)
    text = docs.select("doc_id", F.xxhash64("text").alias("text_key"), raw("text").alias("t"))
    return stored(
        text.join(need, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("hash")))
        .select("ref", F.col("key").alias("wanted"), "n", _set_bytes("t").alias("x"))
        .select("ref", "wanted", "n", "x.*")
        .where("key = wanted")  # other texts may have the same id and hash
        .drop("wanted")
        .dropDuplicates(["key"]),
        "sets",
    )


def _torn(member: DataFrame) -> DataFrame:
    """member (gid, ref, label): holders of signatures -> those of signatures whose holders have several labels, with
    k, their number, and crowd, the label that most of them have."""
    count = member.groupBy("gid", "label").agg(F.count("*").alias("k"))
    count = count.groupBy("gid").agg(F.max(F.struct("k", "label"))["label"].alias("crowd"), F.sum("k").alias("k"), F.count("*").alias("labels"))
    torn = stored(count.where("labels > 1").select("gid", "crowd", "k"), "torn")
    return stored(member.join(torn, "gid"), "open")


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        n = [len(x) for x in some]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(refs, np.int64), n)), pa.array(np.concatenate(some))], names=["ref", "shingle"])

    for batch in batches:
        refs, some, size = [], [], 0
        for ref, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            refs.append(ref)
            some.append(np.frombuffer(v.as_buffer(), np.int64))
            size += len(some[-1])
            if size > BATCH:
                yield rows()
                refs, some, size = [], [], 0
        if some:
            yield rows()


def _apart(refs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the refs whose sets link with none of the others' sets, as too many of their shingles are in no other."""
    mine = sets.join(refs, "ref", "left_semi")
    single = mine.groupBy("ref").agg(F.count("*").alias("keys"), F.first("n").alias("n")).where("keys = 1")  # a ref of two sets stays
    own = mine.select("ref", "shingles").mapInArrow(_each_shingle, "ref long, shingle long")
    own = own.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("ref").alias("ref")).where("holders = 1")
    return own.groupBy("ref").agg(F.count("*").alias("own")).join(single, "ref").where(DEN * F.col("own") > (DEN - NUM) * F.col("n")).select("ref")


def _crowds(held: DataFrame, sets: DataFrame) -> DataFrame:
    """held (crowd, ref, label, minor, n): members of crowds -> linked pairs (a, b) of keys that join labels.

    Only the minor members, those outside the crowd's largest component, are compared with all. Members are dealt by
    size, in steps of which at most two lie between sets that link, and into blocks of bounded size; a task multiplies a
    block of minor members by a block of members.
    """
    held = held.withColumn("step", F.floor(F.log(F.col("n")) / math.log(math.sqrt(DEN / NUM))).cast("int"))
    blocks = lambda most: F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int")
    left = held.where("minor").groupBy("crowd", "step").agg(blocks(MINORS).alias("blocks")).select("crowd", F.col("step").alias("step_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("blocks").alias("of_a"))
    right = held.groupBy("crowd", "step").agg(blocks(MEMBERS).alias("blocks")).select("crowd", F.col("step").alias("step_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("blocks").alias("of_b"))
    # a set's reach is (4/3) times its size, two steps; a third for what rounding takes
    cells = stored(left.join(right, "crowd").where("abs(step_a - step_b) <= 3"), "cells")
    part = lambda of: F.pmod(F.xxhash64("ref"), F.col(of)).cast("int")
    cell = ["crowd", "step_a", "i", "step_b", "j"]
    dealt = None
    for side, step, of, no in ((True, "step_a", "of_a", "i"), (False, "step_b", "of_b", "j")):
        mine = held.where("minor") if side else held
        sizes = cells.select("crowd", step, of).distinct()
        mine = mine.withColumnRenamed("step", step).join(sizes, ["crowd", step]).withColumn(no, part(of)).select("crowd", step, no, "ref", "label")
        mine = mine.join(cells.select(*cell), ["crowd", step, no]).select(*cell, "ref", "label", F.lit(side).alias("minor"))
        dealt = mine if dealt is None else dealt.union(mine)
    return dealt.join(sets.select("ref", "key", "n", "shingles"), "ref").drop("ref").groupBy(*cell).applyInArrow(_multiplied, "a binary, b binary")


def _multiplied(table: pa.Table) -> pa.Table:
    """The links between a block of minor members and a block of members that join labels, a spanning few of them."""
    keys, n = table.column("key").to_pylist(), table.column("n").to_numpy()
    minor = table.column("minor").to_numpy(zero_copy_only=False)
    _, label = np.unique(np.array([x.hex() for x in table.column("label").to_pylist()]), return_inverse=True)
    flat = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")])
    row = np.repeat(np.arange(len(keys)), n)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = times[col] > 1  # others are in no intersection
    row, col = row[use], np.unique(col[use], return_inverse=True)[1]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a, b = np.flatnonzero(minor), np.flatnonzero(~minor)
    place = np.empty(len(keys), np.int64)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    shared = np.zeros((len(a), len(b)), np.float32)
    width = 2048
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        p, q = np.searchsorted(col, [start, start + width])
        r, c = row[p:q], col[p:q] - start
        left, right = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        left[place[r[minor[r]]], c[minor[r]]] = 1
        right[place[r[~minor[r]]], c[~minor[r]]] = 1
        shared += left @ right.T
    x, y = np.nonzero((DEN * shared >= NUM * (n[a][:, None] + n[b][None, :] - shared)) & (label[a][:, None] != label[b][None, :]))
    up = list(range(int(label.max()) + 1))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    left, right = [], []
    for i, j in zip(a[x].tolist(), b[y].tolist(), strict=True):
        p, q = top(label[i]), top(label[j])
        if p != q:
            up[p] = q
            left.append(keys[i])
            right.append(keys[j])
    return pa.table([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def _likely(found: DataFrame) -> DataFrame:
    """ref, band, margin, x (the holder that shares most of the following), groups: the rarest of the signatures that a
    set shares, as many as a linked set can't all miss, each with the number of those that are no rarer."""
    w = Window.partitionBy("ref", "band")
    rows = found.repartition("ref", "band").groupBy("ref", "band", "margin", "gid", "size").agg(F.sum("times").alias("times"), F.max_by("x", "times").alias("x"))
    rest = F.sum("times").over(w.orderBy(F.desc("size"), F.desc("gid")))
    rows = rows.withColumn("shared", F.sum("times").over(w)).where("shared >= margin").withColumn("rest", rest).where("rest >= margin")
    best = rows.groupBy("ref", "band", "margin", "x").agg(F.sum("times").alias("t"), F.collect_list(F.struct("gid", "rest")).alias("g"))
    return best.groupBy("ref", "band", "margin").agg(F.max(F.struct("t", "x"))["x"].alias("x"), F.flatten(F.collect_list("g")).alias("groups"))


def link(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row for each row: doc_id, text_key (a hash of the text), n_shingles, key (equal sets have
    equal keys), component (a key of its component; null for empty sets), component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    nodes = stored(docs.withColumn("x", _node(raw("text"))).select("doc_id", F.xxhash64("text").alias("text_key"), "x.n", "x.key"), "nodes")
    ref = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    classes = nodes.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("n").alias("n"))
    classes = stored(classes.withColumn("ref", ref), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 1
    bands = bands_to(largest)
    # signatures a band, to deal out the buckets: at most one row a band
    low = F.array([F.lit(b[0]) for b in bands])
    weight = {r.band: r.s for r in nodes.where("n > 0").groupBy(F.size(F.filter(low, lambda x: x <= F.col("n"))).alias("band")).agg(F.sum("n").alias("s")).collect()}
    load = [weight.get(i + 1, 0) * 0.5 + weight.get(i + 2, 0) * 0.5 for i in range(len(bands))]
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(sum(load) / BUCKET))
    n_buckets = np.array([max(1, math.ceil(buckets * x / max(1, sum(load)))) for x in load], np.int64)
    first_bucket = np.concatenate([[0], np.cumsum(n_buckets)[:-1]])
    packed = docs.select(raw("text").alias("t")).mapInArrow(_packer(bands, first_bucket, n_buckets), "bucket long, packed binary")
    found = packed.groupBy("bucket").applyInArrow(_finder(first_bucket), _FOUND)
    held = stored(_likely(found), "held")

    # each set with the one that shares most of its rare signatures
    sets = _sets_of(held.select("ref").union(held.select("x")).distinct(), classes, docs)
    pairs = stored(held.select(F.least("ref", "x").alias("a"), F.greatest("ref", "x").alias("b")).distinct(), "pairs")
    links = stored(_verified(pairs, sets), "links")
    label = components(links)  # node, label: keys

    # holders of a signature that are not yet in one component; sets without a link are their own label
    named = classes.select("ref", "key", "n").join(held.select("ref").distinct(), "ref", "left_semi").join(label, F.col("key") == F.col("node"), "left")
    named = stored(named.select("ref", "n", F.coalesce("label", "key").alias("label")), "named")
    # non-empty segments, of which a linked set misses as many as the two differ in at most
    limit = F.when(F.size(F.filter(low, lambda x: x <= F.col("n"))) == F.col("band") + 1, F.floor(F.col("n") / 3)).otherwise(F.floor(2 * F.col("n") / 7))
    segments = F.when(F.col("margin") > 0, F.col("margin") + limit).otherwise(0).cast("int").alias("segments")
    member = held.join(named, "ref").select("ref", "n", "label", segments, F.explode("groups").alias("g")).select("ref", "n", "label", "segments", "g.gid", F.col("g.rest").cast("int").alias("rest"))
    member = _torn(member).drop("crowd", "k")
    member = _torn(member.join(_apart(member.select("ref").distinct(), sets), "ref", "left_anti"))
    few = member.where(F.col("k") <= COMMON)
    side = lambda p: few.select("gid", *[F.col(c).alias(f"{c}_{p}") for c in ("ref", "n", "label", "segments", "rest")])
    # the first signature that two linked sets have in common leaves both with as many as they must share
    most = F.floor((DEN - NUM) * (F.col("n_x") + F.col("n_y")) / (DEN + NUM))
    met = side("x").join(side("y"), "gid").where("label_x < label_y").where(NUM * F.greatest("n_x", "n_y") <= DEN * F.least("n_x", "n_y"))
    met = met.where(F.least("rest_x", "rest_y") >= F.greatest("segments_x", "segments_y") - most)
    more = stored(met.select(F.least("ref_x", "ref_y").alias("a"), F.greatest("ref_x", "ref_y").alias("b")).distinct(), "more")
    crowd = member.where(F.col("k") > COMMON).select("crowd", "ref", "label", "n", (F.col("label") != F.col("crowd")).alias("minor")).distinct()
    late = stored(_verified(more, sets).union(_crowds(stored(crowd, "crowd"), sets)).distinct(), "late")
    # components of components
    via = label.select(F.col("node").alias("k"), F.col("label").alias("l"))
    late = late.join(via.toDF("a", "la"), "a", "left").join(via.toDF("b", "lb"), "b", "left")
    merged = components(late.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    top = classes.select("key", "rep").join(label, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    top = top.join(merged.toDF("label", "top"), "label", "left").select("key", "rep", F.coalesce("top", "label").alias("top"))
    low_id = top.groupBy("top").agg(F.min("rep").alias("component_id"))
    final = top.join(low_id, "top").select("key", "component_id", F.col("top").alias("component"))
    return nodes.join(final, "key", "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        "key",
        "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def join_report(docs: DataFrame) -> DataFrame:
    return link(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, and all documents without words; columns as they were.

    Of texts with the same smallest id one stays. Rows equal in id and text are one document, and stay together.
    """
    rows = link(docs)
    first = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id").agg(F.min(F.struct("key", "text_key")).alias("x"))
    i, k = (fresh(docs.columns, x) for x in ("gone_id", "gone_key"))
    stays = first.select(F.col("doc_id").alias("i"), F.col("x.text_key").alias("k"))
    gone = rows.where("n_shingles > 0").join(stays, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left_anti")
    gone = stored(gone.select(F.col("doc_id").alias(i), F.col("text_key").alias(k)).distinct(), "gone")
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(k)), "left_anti")


#: The same rows in DuckDB's SQL, by way of all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
d AS (
  SELECT rid, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda p: array_to_string(list_slice(words, p, p + 4), ' ')) END) AS shingles
  FROM w),
s AS (SELECT rid, len(shingles) AS n, unnest(shingles) AS shingle FROM d),
l AS (
  SELECT a.rid AS x, b.rid AS y
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x, min(d.doc_id) AS least_id FROM r JOIN d ON r.y = d.rid GROUP BY r.x)
SELECT d.doc_id, len(d.shingles)::BIGINT AS n_shingles, c.least_id AS component_id
FROM d JOIN c ON c.x = d.rid
"""
