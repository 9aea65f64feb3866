"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def alnum(t):
    return re.findall(ALNUM, low(t))


def spaced(t):
    return re.findall(SPACED, t or "")


def quality(t):
    t = t or ""
    w = spaced(t)
    lines = [x for x in t.split("\n") if re.search(SPACED, x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    inside = {j for i, x in enumerate(win) if c[x] > 1 for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def shingle_set(t):
    w = spaced(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """rows (doc_id, text) -> component id of each row, in order."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((min(ids) if ids else None) if sets[i] else doc)
    return out


def hits(t, items, width=10):
    w = alnum(t)
    at, found = set(), set()
    for name, x in items:
        b = alnum(x)
        size = min(width, len(b))
        wins = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                at |= set(range(i, i + size))
                if name is not None:
                    found.add(str(name))
    ids = sorted(found)
    return len(w), len(at), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(at)


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licenses(t):
    w = alnum(t)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(t):
    t = t or ""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, t) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort()
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return tuple(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed


UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + UPPER.lower(), "base52": UPPER + UPPER.lower(), "base62": UPPER + UPPER.lower() + DIGITS}


def randomness(token, encoding):
    """The battery's p-value of a token, from the exact normal distribution."""
    alphabet = ENCODINGS[encoding]
    x, k, n = [alphabet.index(c) for c in token], len(alphabet), len(token)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = sum(c * c for c in Counter(x).values()) * k / n - n
    v = 2 / (9 * (k - 1) * n / (n - 1))
    p_chi = tail((max(chi, 0) ** (1 / 3) / (k - 1) ** (1 / 3) - 1 + v) / math.sqrt(v))
    high = [2 * y >= k for y in x]
    runs, h = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
    mu = 1 + 2 * h * (n - h) / n
    p_runs = 2 * tail(abs(runs - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1)))
    mean = sum(x) / n
    spread = sum((y - mean) ** 2 for y in x)
    p_serial = 2 * tail(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False))) / spread * math.sqrt(n))
    half = -sum(math.log(min(max(p, 1e-9), 1)) for p in (p_chi, p_runs, p_serial))
    return max(math.exp(-half) * (1 + half + half * half / 2), 1e-9)


def random_among(p_values, rate):
    """Which p-values are reported: the most, from the largest down, of which those that are more than random ones
    account for stay under the rate, none under a thousandth. Each counts with its hundredth of a decade."""
    bucket = [min(900, math.floor(-100 * math.log10(p))) for p in p_values]
    below = lambda b: 10 ** (-(b + 1) / 100) if b < 900 else 0
    random = sum(b <= 30 for b in bucket) / (1 - below(30))
    good = [b for b in bucket if b < 300 and 1 - random * (1 - below(b)) / sum(x <= b for x in bucket) <= rate]
    return [bool(good) and b <= max(good) for b in bucket]


def backoff(rows, alpha=0.4):
    """rows (doc_id, text) -> summed log score of each row."""
    docs = [alnum(t) for _, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    all_, corpus = Counter(), sum(map(len, docs))
    for w in docs:
        all_.update(grams(w))
    out = []
    for w in docs:
        own, total = grams(w), 0.0
        c = lambda g, own=own: all_[g] - own[g]
        for i in range(len(w)):
            n = c((w[i],))
            s = (n if n > 0 else alpha) / max(corpus - len(w), 1)
            for k in (1, 2):
                if i >= k:
                    g = tuple(w[i - k : i + 1])
                    s = c(g) / c(g[:-1]) if c(g) > 0 else alpha * s
            total += math.log(s)
        out.append(total)
    return out


def lcs_cuts(theirs, ours):
    """Line numbers of ours that a patience diff may align: used on pairs whose common lines are unique and in order."""
    return [j for j, x in enumerate(ours) if x in theirs]


def repeated_lines(before, lines, least):
    """Line numbers inside any run of lines with enough words that stands in a document before, by trying all runs."""
    n, cut = len(lines), set()
    for i in range(n):
        for j in range(i + 1, n + 1):
            if sum(len(spaced(x)) for x in lines[i:j]) >= least and any(t[k : k + j - i] == lines[i:j] for t in before for k in range(len(t))):
                cut |= set(range(i, j))
    return sorted(cut)
