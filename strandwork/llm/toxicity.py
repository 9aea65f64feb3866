"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its word vector plus the mean vector of its character 3- to 5-grams (word ends marked). Forward and
backward gated recurrent units read a window of ``WINDOW`` words, attention pools their states, and a logistic unit
scores the window. Windows overlap (``STRIDE`` words apart, the last one flush with the end) and cover the whole text; a
document's score is that of its highest window, and training is likewise: the label teaches the window that scores
highest.

The network is fitted on the driver to a bounded sample of labelled rows (``SAMPLE`` of each class, chosen by a hash of
the id, whatever their length) and broadcast, a few megabytes whatever the input. Scoring is one Arrow pass without a
shuffle.

Defined results: null and empty texts, and texts without words, score 0. Without labels of both classes every score is
0. Rows with null ids are scored and never held out; repeated rows score alike; texts of any length are scored to their
end; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm.common import alnum_words, fresh, raw

WINDOW, STRIDE = 32, 16
#: Labelled rows of each class to train on; word and character vocabularies; epochs.
SAMPLE, MAX_WORDS, MAX_GRAMS, EPOCHS = 800, 20_000, 60_000, 8
DIM, HIDDEN, ATTEND = 12, 8, 8
SLOTS = 1 << 21
THRESHOLD = 0.7

_U = np.uint64


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the word) of all character 3- to 5-grams of ^word$."""
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    hashes, owners = [], []
    for n in (3, 4, 5):
        if len(flat) < n:
            break
        h = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ flat[k : len(flat) - n + 1 + k]) * _U(0x100000001B3)
        h ^= h >> _U(29)
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        inside = of[: len(h)] == of[n - 1 :]
        hashes.append(h[inside])
        owners.append(of[: len(h)][inside])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def windows_of(n: int) -> list[int]:
    """Starts of the windows over n words."""
    if n <= WINDOW:
        return [0] if n else []
    out = list(range(0, n - WINDOW, STRIDE))
    return [*out, n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    def __init__(self, words: dict[bytes, int], gram_hashes: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        r = lambda *s, by=0.3: rng.normal(0, by, s).astype(np.float32)
        self.words = words
        self.slot = np.zeros(SLOTS, np.int32)
        at = (gram_hashes & _U(SLOTS - 1)).astype(np.int64)
        self.slot[at[::-1]] = np.arange(len(gram_hashes), 0, -1)  # of two in a slot the more frequent stays
        self.gram_hashes = np.concatenate([[_U(0)], gram_hashes])
        self.p = {"word": r(len(words) + 1, DIM, by=0.1), "gram": r(len(self.gram_hashes), DIM, by=0.1), "attend": r(2 * HIDDEN, ATTEND), "v": r(ATTEND), "u": r(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": r(DIM, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32), f"re_{d}": r(HIDDEN, 3 * HIDDEN)}
        self.p["word"][0] = 0
        self.p["gram"][0] = 0

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers; gram numbers, their words and the inverse gram counts of the words."""
        wid = np.fromiter((self.words.get(w, 0) for w in words), np.int64, len(words))
        h, of = _grams(words)
        g = self.slot[(h & _U(SLOTS - 1)).astype(np.int64)]
        g = np.where(self.gram_hashes[g] == h, g, 0)
        count = np.maximum(np.bincount(of, minlength=len(words)), 1).astype(np.float32)
        known = g > 0
        return wid, g[known], of[known], 1 / count

    def compose(self, found) -> np.ndarray:
        """Input vectors of words."""
        wid, g, of, inverse = found
        out = np.stack([np.bincount(of, self.p["gram"][g, j], len(wid)) for j in range(DIM)], 1).astype(np.float32) if len(g) else np.zeros((len(wid), DIM), np.float32)
        return self.p["word"][wid] + out * inverse[:, None]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Both directions' input projections, side by side."""
        return np.concatenate([x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"], 1)

    def _run(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None) -> np.ndarray:
        steps, size = ids.shape
        u, off = self.p[f"re_{d}"], 0 if d == "f" else 3 * HIDDEN
        h = np.zeros((size, HIDDEN), np.float32)
        out = np.empty((steps, size, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = proj[ids[t], off : off + 3 * HIDDEN]
            g = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            gn = g[:, 2 * HIDDEN :]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, gn, n))
            out[t] = h = new
        return out

    def forward(self, proj: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; ids: word numbers in proj by step and window."""
        back: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(proj, ids, mask, d, back[d] if keep is not None else None) for d in "fb"], 2)
        th = np.tanh(h @ self.p["attend"])
        e = th @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        c = np.einsum("tb,tbh->bh", a, h)
        if keep is not None:
            keep |= {"back": back, "h": h, "th": th, "a": a, "c": c}
        return c @ self.p["u"] + self.p["b"][0]

    def gradients(self, proj, ids, mask, keep, dlogit, x) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the input vectors x."""
        p, h, th, a = self.p, keep["h"], keep["th"], keep["a"]
        g = {"u": keep["c"].T @ dlogit, "b": np.array([dlogit.sum()], np.float32)}
        dc = dlogit[:, None] * p["u"]
        da = np.einsum("bh,tbh->tb", dc, h)
        dh = a[:, :, None] * dc
        de = a * (da - (a * da).sum(0))
        dt = de[:, :, None] * p["v"] * (1 - th * th)
        g["v"] = np.einsum("tb,tbk->k", de, th)
        g["attend"] = np.einsum("tbh,tbk->hk", h, dt)
        dh = dh + dt @ p["attend"].T
        dproj = np.zeros_like(proj)
        for i, d in enumerate("fb"):
            u = p[f"re_{d}"]
            du, carry = np.zeros_like(u), np.zeros((ids.shape[1], HIDDEN), np.float32)
            cols = range(3 * HIDDEN * i, 3 * HIDDEN * (i + 1))
            dxs, at = [], []
            for t, h0, z, r, gn, n in reversed(keep["back"][d]):
                total = carry + dh[t, :, HIDDEN * i : HIDDEN * (i + 1)]
                live = total if mask is None else np.where(mask[t][:, None], total, 0)
                dn = live * (1 - z) * (1 - n * n)
                dz = live * (h0 - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], 1)
                du += h0.T @ dg
                carry = live * z + dg @ u.T + (total - live)
                dxs.append(np.concatenate([dz, dr, dn], 1))
                at.append(ids[t])
            dx, at = np.concatenate(dxs), np.concatenate(at)
            for k, col in enumerate(cols):
                dproj[:, col] = np.bincount(at, dx[:, k], len(proj))
            part = dproj[:, cols.start : cols.stop]
            g |= {f"re_{d}": du, f"in_{d}": x.T @ part, f"bias_{d}": part.sum(0)}
        dx = sum(dproj[:, 3 * HIDDEN * i : 3 * HIDDEN * (i + 1)] @ p[f"in_{d}"].T for i, d in enumerate("fb"))
        return g, dx


def _cut(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """All windows of some documents' word numbers: ids by step and window, the window's document, mask or None."""
    starts, owner = [], []
    offset = 0
    lengths = []
    for i, d in enumerate(docs):
        for s in windows_of(len(d)):
            starts.append(offset + s)
            owner.append(i)
            lengths.append(min(WINDOW, len(d)))
        offset += len(d)
    flat = np.concatenate([*docs, np.zeros(WINDOW, np.int64)])
    steps = np.arange(WINDOW)[:, None]
    lengths = np.array(lengths, np.int64)
    mask = steps < lengths
    ids = np.where(mask, flat[np.array(starts, np.int64) + steps], 0)
    return ids, np.array(owner, np.int64), None if mask.all() else mask


def train(rows: list[tuple[bytes, int]], seed: int = 11, epochs: int = EPOCHS) -> Network | None:
    """rows: text and label."""
    docs = [(alnum_words(t), y) for t, y in rows]
    docs = [(w, y) for w, y in docs if w]
    if len({y for _, y in docs}) < 2:
        return None
    df = Counter(w for words, _ in docs for w in set(words))
    vocabulary = {w: i + 1 for i, (w, n) in enumerate(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:MAX_WORDS]) if n > 1}
    distinct = sorted(df)
    h, of = _grams(distinct)
    weight = np.array([df[w] for w in distinct], np.float64)[of]
    grams, back = np.unique(h, return_inverse=True)
    often = np.bincount(back, weight)
    order = np.argsort(-often, kind="stable")
    grams = grams[order][often[order] > 2][:MAX_GRAMS]
    net = Network(vocabulary, grams, seed)
    number = {w: i for i, w in enumerate(distinct)}
    found = net.lookup(distinct)
    ids = [np.array([number[w] for w in words], np.int64) for words, _ in docs]
    y = np.array([label for _, label in docs], np.float32)
    rng = np.random.default_rng(seed)
    weigh = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    size = 64 if len(ids) >= 1500 else 16  # few rows take more and smaller steps
    for epoch in range(epochs if size == 64 else 2 * epochs):
        for batch in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // size)):
            part, owner, mask = _cut([ids[i] for i in batch])
            used, local = np.unique(part, return_inverse=True)
            local = local.reshape(part.shape)
            sub = _only(found, used)
            x = net.compose(sub)
            proj = net.inputs(x)
            if epoch:
                score = net.forward(proj, local, mask)
                order = np.lexsort((score, owner))
                pick = order[np.append(owner[order][1:] != owner[order][:-1], True)]
            else:  # before the network can tell windows apart, each teaches
                pick = np.arange(len(owner))
            per = 1 / np.bincount(owner[pick], minlength=len(batch)).astype(np.float32)
            keep: dict = {}
            m = None if mask is None else mask[:, pick]
            logit = net.forward(proj, local[:, pick], m, keep)
            of_doc = batch[owner[pick]]
            d = ((_sigmoid(logit) - y[of_doc]) * weigh[of_doc] * per[owner[pick]] / len(batch)).astype(np.float32)
            g, dx = net.gradients(proj, local[:, pick], m, keep, d, x)
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            wid, gid, gof, inverse = sub
            for j in range(DIM):
                g["word"][:, j] = np.bincount(wid, dx[:, j], len(g["word"]))
                g["gram"][:, j] = np.bincount(gid, (dx[:, j] * inverse)[gof], len(g["gram"]))
            g["word"][0] = g["gram"][0] = 0
            step += 1
            for k, v in g.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.01 * (v * v - m2)
                rate = 0.01 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                net.p[k] -= (rate * m1 / (np.sqrt(m2) + 1e-8)).astype(np.float32)
    return net


def _only(found, used: np.ndarray):
    """The lookup of some words."""
    wid, g, of, inverse = found
    place = np.full(len(wid), -1, np.int64)
    place[used] = np.arange(len(used))
    mine = place[of] >= 0
    return wid[used], g[mine], place[of[mine]], inverse[used]


class Scorer:
    """A network with the projections of the words it has met; a task has one."""

    def __init__(self, net: Network):
        self.net, self.rows, self.proj = net, {}, np.empty((0, 6 * HIDDEN), np.float32)

    def score(self, texts: list[bytes]) -> list[float]:
        if len(self.rows) > 150_000:
            self.rows, self.proj = {}, self.proj[:0]
        docs = [alnum_words(t) for t in texts]
        new = list(dict.fromkeys(w for words in docs for w in words if w not in self.rows))
        if new:
            self.rows |= zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True)
            self.proj = np.concatenate([self.proj, self.net.inputs(self.net.compose(self.net.lookup(new)))])
        get = self.rows.__getitem__
        out = np.zeros(len(texts))
        ids, owner, mask = _cut([np.fromiter(map(get, words), np.int64, len(words)) for words in docs])
        short = np.zeros(len(owner), bool) if mask is None else ~mask[-1]
        for masked in (False, True):
            use = np.flatnonzero(short == masked)
            for a in range(0, len(use), 4096):
                w = use[a : a + 4096]
                logit = self.net.forward(self.proj, ids[:, w], mask[:, w] if masked else None)
                np.maximum.at(out, owner[w], _sigmoid(logit))
        return out.tolist()


def _pieces(texts: list[bytes], limit: int = 1 << 20):
    """Consecutive texts of about a megabyte, so that memory is bounded by the longest text."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _scorer(net):
    kept: list[Scorer] = []

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if net.value is None:
            return pa.array([0.0] * len(texts), pa.float64())
        if not kept:
            kept.append(Scorer(net.value))
        return pa.array([x for part in _pieces(texts.to_pylist()) for x in kept[0].score(part)], pa.float64())

    return score.asNondeterministic()


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most size labelled texts of each class, never a held-out row."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    rows = docs.select("doc_id", raw("text").alias("t")).join(F.broadcast(some[0].union(some[1])), "doc_id")  # at most 2 * size ids
    rows = rows.select("t", "toxic", F.xxhash64("t").alias("h"))  # of several rows with one id, as many as there is room for
    return [(bytes(r.t), r.toxic) for y in (0, 1) for r in rows.where(F.col("toxic") == y).orderBy("h", "t").limit(size).collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, str]:
    """docs with a score; and its column's name."""
    net = train(sample(docs, labels, size))
    name = fresh(docs.columns, "score")
    return docs.withColumn(name, _scorer(docs.sparkSession.sparkContext.broadcast(net))(raw("text"))), name


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held, name = score_toxicity(docs.select("doc_id", "text"), labels)
    return held.select("doc_id", held_out().alias("held_out"), F.col(name).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
