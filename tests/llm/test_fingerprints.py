"""Bottom-k sketches against plain sets, and neighbours against a plain sorted list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandwork.llm import fingerprints as fp
from tests.llm.brute import spaced
from tests.llm.conftest import clashing, prose


def hashes(t):
    w = spaced(t)
    return {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:12] for i in range(max(1, len(w) - 4))} if w else set()


def sketch(t, k=100):
    return sorted(hashes(t))[:k]


def like(a, b, k=100):
    u = sorted({*a, *b})[:k]
    return len([x for x in u if x in a and x in b]) / len(u) if u else 1.0


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha256(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_report(spark, docs, edges, block):
    want = plain([(r[0], r[1]) for r in edges])
    assert rows(fp.fingerprint_report(clashing(docs), block)) == want


@pytest.mark.parametrize("ids", [[1], [1, None], [None], [None, None, None], [7, 7, 7, 2, 2, -5, 10**18], []])
def test_neighbours(spark, ids):
    given = [(i, f"text number {k} of these and more words {k}") for k, i in enumerate(ids)]
    got = fp.fingerprint_report(spark.createDataFrame(given, "doc_id long, text string"), 1)
    assert rows(got) == plain(given)


def test_merge_and_estimates(spark):
    """Parts' sketches merge into the whole's; small sets are exact, large ones near."""
    rng = random.Random(2)
    a, b = prose(rng, 4000), prose(rng, 4000)
    cases = [(a, a), (a, b), (a + " " + b, a), ("few words here stand now " + a[:60], "few words here stand now"), ("", ""), ("", a)]
    df = spark.createDataFrame(cases, "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    got = df.select(fp.merged(F.col("a"), F.col("b")), fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("b"), F.col("a")), fp.distinct_shingles(F.col("a"))).collect()
    for (x, y), (both, near, inside, n) in zip(cases, got, strict=True):
        hx, hy = hashes(x), hashes(y)
        assert both == sorted(hx | hy)[:100]
        assert abs(near - (len(hx & hy) / len(hx | hy) if hx | hy else 1)) < 0.15
        assert n == len(hx) if len(hx) < 100 else abs(n / len(hx) - 1) < 0.4
        assert inside is None if not hy else abs(inside - len(hx & hy) / len(hy)) < 0.4
    parts = [("x", a[:9000]), ("x", a[9000:]), ("x", a[:9000]), ("y", "one two"), ("z", "")]
    merged = fp.merged_by(spark.createDataFrame(parts, "part string, t string").select("part", fp.sketch(F.col("t")).alias("sketch")), "part")
    assert {r["part"]: r["sketch"] for r in merged.collect()} == {"x": sorted(hashes(a[:9000]) | hashes(a[9000:]))[:100], "y": sketch("one two")}


def test_native(spark, docs):
    plan = fp.fingerprint_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("md5") == 2
