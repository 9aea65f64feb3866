"""The pipeline against a brute-force version of its stages, on a small folder of tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from strandwork.llm import linededup, mixing
from tests.llm import brute
from tests.llm.conftest import prose
from tests.llm.test_corpus import weights

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


def rows():
    rng = random.Random(11)
    line = lambda: prose(rng, rng.randint(10, 25))
    docs = [[line() for _ in range(rng.randint(2, 5))] for _ in range(14)]
    texts = ["\n".join(d) for d in docs]
    texts += ["\n".join([line(), docs[0][1], line()]), "\n".join([*docs[1][:2], line()])]  # shared lines
    texts += [texts[2], texts[3]]  # copies
    for t in texts[4:8]:  # near copies, in one line so that only the Jaccard join sees them
        w = t.split()
        w[5] = "changed"
        texts.append(" ".join(w))
    texts += [prose(rng, 30) + " " + ITEM.title() + " " + prose(rng, 9), "too short", "", None, "spam spam spam spam spam " * 9, "w%%% " * 40]
    return [(i, t, "en", "st"[i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def brute_force():
    kept = [(i, t, s) for i, t, _, s, _ in rows() if not brute.quality(t)[-1] and brute.quality(t)[2] == 0]
    known, out = set(), []
    for i, t, s in kept:  # in order of id: a line goes if it stands in a run of enough words that an earlier document has
        lines, gone = t.split("\n"), set()
        runs = {(j, k): tuple(lines[j:k]) for j in range(len(lines)) for k in range(j + 1, len(lines) + 1)}
        runs = {at: run for at, run in runs.items() if sum(len(brute.spaced(x)) for x in run) >= linededup.BLOCK_WORDS}
        for (j, k), run in runs.items():
            if run in known:
                gone |= set(range(j, k))
        known |= set(runs.values())
        t = "\n".join(x for j, x in enumerate(lines) if j not in gone)
        if brute.spaced(t):
            out.append((i, t, s))
    ids = brute.components([(i, t) for i, t, _ in out])
    out = [x for x, c in zip(out, ids, strict=True) if x[0] == c]
    return [x for x in out if not brute.hits(x[1], [(1, ITEM)])[-1]]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert [len(s) for s in seen.values()] == sorted((len(s) for s in seen.values()), reverse=True)
    want = {i: t for i, t, _ in brute_force()}
    assert seen["decontamination"] == want


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    want = brute_force()
    tokens = {i: len(brute.spaced(t)) for i, t, _ in want}
    assert {r.doc_id: r.n_tokens for r in got}.items() <= tokens.items()
    own, drawn = Counter(), Counter()
    for i, _, s in want:
        own[s] += tokens[i]
    for r in got:
        drawn[r.source] += r.n_tokens
    assert len(got) == len({(r.doc_id, r.epoch) for r in got})
    target = weights(own, mixing.ENTROPY, mixing.REPEATS)
    longest = max(tokens.values())
    for s in own:
        want_tokens = target[s] * sum(own.values())
        assert want_tokens - longest - 0.002 * sum(own.values()) <= drawn[s] <= want_tokens + 1 + 0.002 * sum(own.values())
    times = Counter(r.doc_id for r in got)
    assert all(times[i] >= int(target[s] * sum(own.values()) / own[s]) for i, _, s in want)


def test_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
