"""Line dedup, Jaccard join, mixing, surrogates, backoff scores, toxicity: brute force and defined cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strandwork.llm import backoff, components, jaccard, linededup, mixing, pii, toxicity
from strandwork.llm.common import stored
from tests.llm import brute
from tests.llm.conftest import clashing, prose

# line dedup


def test_patience_blocks():
    blocks = lambda a, b: linededup.patience_blocks(np.array(a, np.int64), np.array(b, np.int64))
    assert blocks([1, 2, 3], [1, 2, 3]) == [(0, 0, 3)]
    assert blocks([], [1]) == [] and blocks([], []) == []
    assert blocks([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1, 2)]
    assert blocks([5, 1, 6, 2, 7], [1, 8, 2]) == [(1, 0, 1), (3, 2, 1)]
    assert blocks([1, 1, 2, 1], [1, 2, 1, 1]) == [(0, 0, 1), (2, 1, 2)] or sum(n for *_, n in blocks([1, 1, 2, 1], [1, 2, 1, 1])) >= 3
    rng = random.Random(3)
    for _ in range(200):
        a, b = [[rng.randrange(8) for _ in range(rng.randrange(14))] for _ in range(2)]
        x = y = 0
        for i, j, n in blocks(a, b):
            assert i >= x and j >= y and n > 0 and a[i : i + n] == b[j : j + n]
            x, y = i + n, j + n


def lines(rng, n):
    return [prose(rng, rng.randint(9, 20)) for _ in range(n)]


def test_line_dedup(spark, docs, none):
    rng = random.Random(9)
    a, shared = lines(rng, 5), lines(rng, 2)
    rows = [
        (1, "\n".join(a)),
        (2, "\n".join(["own words of the second document stand here alone", *a[1:4], "tail"])),
        (3, "\n".join([a[0], "short", *shared])),
        (4, "\n".join([*shared, *lines(rng, 1)])),
        (5, "\n".join(a)),
        (6, "same few words\nof no weight"),
        (7, "same few words\nof no weight"),
        (None, "\n".join(a[:2])),
        (5, "\n".join(a)),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out, name = linededup.dedup_lines(d)
    got = [(r.doc_id, r[name["new_text"]], r[name["n_removed"]]) for r in out.collect()]
    keep4 = rows[3][1].split("\n")[2]
    want = [(1, rows[0][1], 0), (2, rows[1][1].split("\n")[0] + "\ntail", 3), (3, "short\n" + "\n".join(shared), 1), (4, keep4, 2), (5, "", 5), (5, "", 5), (6, rows[5][1], 0), (7, rows[6][1], 0), (None, "", 2)]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = linededup.without_repeats(clashing(d.withColumn("n_chars", F.length("text").cast("long"))))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7]
    assert left.where("n_chars <> length(text)").count() == 0
    assert left.columns == clashing(d.withColumn("n_chars", F.lit(1))).columns
    assert linededup.line_report(docs).count() == docs.count()
    assert linededup.line_report(none).count() == 0


def plain_cut(a, b, words, least):
    """Lines of b in a run of enough words that a has anywhere."""
    runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
    cut = set()
    for i in range(len(b)):
        for j in range(i + 1, len(b) + 1):
            if sum(words[i:j]) >= least and tuple(b[i:j]) in runs:
                cut |= set(range(i, j))
    return cut


def test_alignment_decides(monkeypatch):
    """What the alignments take is what any common run of enough words covers; without them nothing is cut."""
    rng = random.Random(6)
    size = {x: x % 5 * 2 + 1 for x in range(9)}
    cases = [[[rng.randrange(5) for _ in range(rng.randrange(1, 16))] for _ in range(2)] for _ in range(400)]
    cases += [[list(range(9)), list(range(8, -1, -1))], [list(range(9)) * 2, list(range(5, 9)) + list(range(5))]]
    found = 0
    for a, b in cases:
        words = np.array([size[x] for x in b])
        args = np.array(a, np.int64), np.array(b, np.int64), words, 10
        got = set(np.flatnonzero(linededup.aligned(*args)).tolist())
        assert got == plain_cut(a, b, words.tolist(), 10), (a, b)
        found += len(got)
    assert found > 500
    monkeypatch.setattr(linededup, "patience_blocks", lambda a, b: [])
    a = np.arange(5)
    with pytest.raises(ValueError):  # a pass without a block would not end
        linededup.aligned(a, a[::-1].copy(), np.full(5, 20), 10)
    assert not linededup.aligned(a, a + 10, np.full(5, 20), 10).any()


def test_many_lines_and_matches_in_one_text(spark):
    """Four times the lines or matches take no more than some six times as long."""
    import time

    from strandwork.llm import secrets

    seconds = {}
    for n in (2_000, 20_000, 80_000):
        lines_ = "\n".join(["one two three four five six seven"] * n)
        start = time.perf_counter()
        rows = linededup.line_report(spark.createDataFrame([(1, "x\n" + lines_), (2, lines_)], "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (2, n)]
        middle = time.perf_counter()
        row = secrets.secret_report(spark.createDataFrame([(1, "password=abcdef1 a1b2c3d4e5f6a7b8c9d0e1f2a3\n" * (n // 2))], "doc_id long, text string")).first()
        assert (row.n_assign, row.n_hex) == (n // 2, n // 2)
        seconds[n] = (middle - start, time.perf_counter() - middle)
    assert all(b < 6 * a + 2 for a, b in zip(seconds[20_000], seconds[80_000], strict=True)), seconds


def test_blocks_without_owners(spark):
    """Wrapped passages of short lines, stock lines with other owners, moved blocks and blocks without unique lines."""
    rng = random.Random(4)
    verse = [prose(rng, rng.randint(2, 6)) for _ in range(14)]
    one, two = prose(rng, 9), prose(rng, 9)
    chorus = [prose(rng, 3), prose(rng, 3)] * 5
    moved = lines(rng, 4)
    texts = [[one], [two], ["first", one, two], ["second", one, two, "end"], ["third", *verse, "x"], ["fourth", *verse[3:], "y", *verse[:4]]]
    texts += [["fifth", *chorus, "z"], [*chorus[:6], "sixth", *chorus[:8]], ["seventh", *moved], [*moved[2:], "eighth", *moved[:2]]]
    stock = [prose(rng, rng.randint(0, 14)) for _ in range(12)]
    texts += [[rng.choice(stock) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r["at"] for r in linededup.cuts(d).collect()}
    want = {i: cut for i, t in enumerate(texts) if (cut := brute.repeated_lines(texts[:i], t, linededup.BLOCK_WORDS))}
    assert got == want and want[3] == [1, 2] and want[5] == [*range(1, 12), *range(13, 17)]


# Jaccard join


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_edges(docs, edges, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_report(docs).collect())
    ids = brute.components([(i, t) for i, t, *_ in edges])
    assert got == Counter((i, len(brute.shingle_set(t)), c) for (i, t, *_), c in zip(edges, ids, strict=True))
    assert jaccard.join_report(none).count() == 0


def near_copies(seed, common=0):
    """Groups of copies at all distances around the bound, of sizes from a few words up, some with a shared passage."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 40)
    for size in [3, 4, 5, 6, 7, 8, 9, 11, 14, 18, 25, 40, 70, 130, 250]:
        for _ in range(3):
            w = prose(rng, size).split()
            for _ in range(6):
                x = list(w)
                for _ in range(rng.randrange(0, 1 + max(1, size // 20))):
                    x[rng.randrange(len(x))] = "q%d" % rng.randrange(99)
                x = x[: max(3, len(x) - rng.randrange(0, 1 + size // 8))]
                rows.append((len(rows), " ".join(x) + (" " + passage if common and rng.random() < common else "")))
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize(("seed", "limit", "common"), [(1, 64, 0.5), (2, 2, 0.9), (3, 64, 0)])
def test_jaccard_random(spark, monkeypatch, seed, limit, common):
    monkeypatch.setattr(jaccard, "COMMON", limit)  # so low that most signatures are common ones
    rows = near_copies(seed, common)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_report(d).collect()}
    ids = brute.components(rows)
    assert got == {i: (len(brute.shingle_set(t)), c) for (i, t), c in zip(rows, ids, strict=True)}


def test_jaccard_pairs_of_a_growing_family(spark, monkeypatch):
    """Near copies of one text that are too far from each other to link, each with many shingles of its own, make no pairs."""
    made, kept = {}, jaccard.stored

    def counting(df, name):
        out = kept(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counting)
    rng = random.Random(12)
    w = prose(rng, 150).split()
    rows = []
    for i in range(60):
        x = list(w)
        at = rng.randrange(len(w))
        for p in range(at, at + (40 + i % 20 if i > 2 else i)):
            x[p % len(w)] = "q%d" % rng.randrange(10**6)
        rows.append((i, " ".join(x)))
    got = {r.doc_id: r.component_id for r in jaccard.join_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.components(rows), strict=True))
    assert len(set(got.values())) == 58
    assert made["more"] <= 60


def test_jaccard_equal_ids(spark):
    """Different texts under one id, or none, with equally many shingles; links by either of them count."""
    rng = random.Random(8)
    rows = []
    for i in range(6):
        w, v = prose(rng, 40).split(), prose(rng, 40).split()
        one, two = [*w[:-1], "x"], [*v[:-1], "y"]
        shared = 100 + i if i < 4 else None
        rows += [(20 + i, " ".join(w)), (shared, " ".join(one)), (shared, " ".join(two)), (40 + i, " ".join(v))]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == Counter((i, len(brute.shingle_set(t)), c) for (i, t), c in zip(rows, brute.components(rows), strict=True))
    assert jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 12


def test_jaccard_without_margin(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "segments_for", lambda u: u // 3 + 1)  # many sets without a margin
    rows = near_copies(4, 0.3)
    got = {r.doc_id: r.component_id for r in jaccard.join_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], brute.components(rows), strict=True))


def test_one_of_each(docs, edges):
    out = jaccard.one_of_each(clashing(docs))
    assert out.columns == clashing(docs).columns
    kept = [(r.doc_id, brute.shingle_set(r.text)) for r in out.collect()]
    rows = [(i, t) for i, t, *_ in edges]
    ids = brute.components(rows)
    every = {(c, brute.shingle_set(t)) for c, (_, t) in zip(ids, rows, strict=True) if brute.shingle_set(t)}
    # one set of each component stays, under the component's id; ids that two components share are told apart by text
    assert all((i, x) in every for i, x in kept if x)
    assert {i for i, x in kept if x} == {c for c, _ in every}
    for i in {c for c, _ in every}:
        mine = {x for j, x in kept if j == i and x}
        assert len(mine) == (2 if i == 7 else 1)
    assert sum(not x for _, x in kept) == sum(not brute.shingle_set(t) for _, t in rows)


# mixing


def mixture(spark, sizes, **how):
    rng = random.Random(2)
    rows = [(k * 1000 + i, s, prose(rng, rng.randint(5, 30))) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [(9001, "big", None), (9002, None, ""), (9003, None, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    own = Counter()
    for _, s, t in rows:
        own[s] += len(brute.spaced(t))
    return d, {s: n for s, n in own.items() if n}, mixing.mix(d, **how).collect()


def weights(own, entropy, repeats, budget=1.0):
    total = sum(own.values())
    p = [n / total for n in own.values()]

    def at(a):
        w = [x**a for x in p]
        w = [x / sum(w) for x in w]
        return -sum(x * math.log(x) for x in w), max(x / y for x, y in zip(w, p, strict=True)) * budget, w

    steps = [k / 20000 for k in range(20001)]
    a = max((x for x in steps if at(x)[0] >= entropy * math.log(len(p))), default=0)
    least = min((x for x in steps if at(x)[1] <= repeats), default=1)
    return dict(zip(own, at(max(a, least))[2], strict=True))


@pytest.mark.parametrize(("entropy", "repeats"), [(0.98, 4.0), (0.999, 1.5), (0.5, 4.0)])
def test_mixing_meets_targets(spark, entropy, repeats):
    d, own, rows = mixture(spark, {"big": 300, "mid": 60, "small": 20, None: 15}, entropy=entropy, repeats=repeats, block_tokens=200)
    got, times = Counter(), Counter()
    for r in rows:
        got[r.source] += r.n_tokens
        times[r.doc_id, r.epoch] += 1
    total, want = sum(own.values()), weights(own, entropy, repeats)
    for s in own:
        target = want[s] * total
        assert target - 2 * 30 - 0.002 * total <= got[s] <= target + 1 + 0.002 * total  # short of the budget by a document at most
    assert max(times.values()) == 1
    passes = defaultdict(set)
    for r in rows:
        passes[r.doc_id].add(r.epoch)
    assert all(p == set(range(1, len(p) + 1)) for p in passes.values())
    assert len({r.block_order for r in rows}) > 10


def test_mixing_one_source_and_none(spark, none, docs):
    _, own, rows = mixture(spark, {"big": 5})
    assert sum(r.n_tokens for r in rows) == own["big"]
    assert mixing.mix(none).count() == 0
    assert mixing.mix(clashing(docs)).count() > 0
    d, own, rows = mixture(spark, {"big": 50, "small": 5}, entropy=None, repeats=None, budget=100, block_tokens=50)
    assert 100 - 62 <= sum(r.n_tokens for r in rows) <= 100


# surrogates

PRIVATE = [
    "write to anna.b12@mail.example.com or ANNA.B12@mail.example.com now",
    "card 4539 1488 0343 6467, again 4539148803436467 and 10.0.0.1",
    "+1 (521) 555-6210 vs +15215556210; 123-45-6789",
    "Frau Müller and Mrs. Jane Doe met Mr Jane Doe, Господин Иванов",
    "clean text 1.2.3 with 2024 numbers and a@b",
    "DE44 5001 0517 5407 3249 31 é東 anna.b12@mail.example.com",
    None,
    "",
]


FOREIGN = [
    "γιώργος.παπαδόπουλος@παράδειγμα.ελ",
    "йщъыьё@почта.рф and łżźć.ąę@przykład.pl and 山田٣٤@例え.jp",
    "Mr Ωμέγα met Herr Łążźć and Mrs Շուշան and Господин Йщё",
    "Mr. Xx saw Mr Xx and Mrs. Ελένη Παππά",
]


def test_surrogates_of_all_scripts(spark):
    d = spark.createDataFrame(list(enumerate(FOREIGN)), "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.pii_report(d, "k").collect()}
    keep = 0
    for i, old in enumerate(FOREIGN):
        for a, b in zip(old.split(), new[i].split(), strict=True):
            if "@" in a:
                x, y = a.split("@")[0], b.split("@")[0]
                assert len(x) == len(y) and x != y and b.endswith(".example")
                keep += sum(p == q for p, q in zip(x, y, strict=True) if p.isalnum())
    assert keep <= 8  # by chance at most
    words = [x.split() for x in new.values()]
    assert not {"Ωμέγα", "Łążźć", "Շուշան", "Йщё", "Ελένη", "Παππά"} & {w for x in words for w in x}
    assert words[3][:2] == ["Mr.", words[3][4]] and words[3][3] == "Mr" and words[3][6] == "Mrs."
    assert all("Ͱ" <= c <= "Ͽ" for c in words[2][1] + words[3][7] + words[3][8])


def test_surrogates_where_all_short_ones_are_taken(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("family", f"{x.upper()}{y}", None) for x in letters for y in letters] + [("email", f"{x}@{y}.example", None) for x in letters for y in letters]
    rows += [("name", f"m|{x.upper()}. Bo", "Zu") for x in letters] + [("name", f"m|{x.upper()}{y} Bo", "Zu") for x in letters for y in "aeiou"] + [("name", f"{g}|van Bo", "Zu") for g in "mfn"]
    entities = spark.createDataFrame(rows, "kind string, norm string, family string")
    got = pii._agreed(stored(entities, "entities"), "k").collect()
    assert sorted((r.kind, r.norm) for r in got) == sorted(r[:2] for r in rows)
    values = {(r.kind, r.value) for r in got}
    assert len(values) == len(rows) and not values & {r[:2] for r in rows}
    assert all(r.value.endswith(" Zu") for r in got if r.kind == "name") and ("name", "f|van Zu") in values
    longer = spark.createDataFrame([("card", "4539148803436467"), ("ssn", "123456789"), ("ip", "10.0.0.1")], "kind string, norm string")
    out = {r.kind: r.v for r in longer.select("kind", pii.surrogate(F.col("kind"), F.col("norm"), F.lit(6), F.lit(None).cast("string"), "k").alias("v")).collect()}
    assert len(out["card"]) == 19 and luhn(out["card"]) and len(out["ssn"]) == 12 and out["ip"].count(".") == 6


def iban_holds(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


NAMED = [
    "Mr McDonald met Ms Anne-Marie Smith, Mrs O'Neil and Mr John Ronald Tolkien.",
    "Dr. J. R. R. Tolkien's friend Sir Vincent van der Berg; Herr Dr. Müller. Mr John Smith, then Mr Smith and Mrs Smith's dog",
    "cards 378282246310005 or 3782 822463 10005, 6011000990139424123, order 378282246310006 and time 1700000000000",
    "from 2001:db8::8a2e:370:7334 and 2001:0DB8:0000:0000:0000:8a2e:0370:7334 to fe80::1 at 10:30:15, std::vector",
    "GB82 WEST 1234 5698 7654 32 and DE62446888420123456789 and 4539148803436467 4539 1488 0343 6467",
]


def test_surrogates_leave_nothing_half(spark):
    d = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(d, "k").collect()}
    new = [got[i].text for i in range(len(NAMED))]
    assert [got[i].n_entities for i in range(len(NAMED))] == [4, 6, 2, 3, 4]
    for word in ("Donald", "Anne", "Marie", "Neil", "John", "Ronald", "Tolkien", "Vincent", "Berg", "Müller", "Smith"):
        assert word not in new[0] and word not in new[1], (word, new[:2])
    assert new[0].startswith("Mr ") and new[0].endswith(".") and "'" in new[0].split(" and ")[0]
    assert " van der " in new[1] and "'s friend Sir " in new[1] and "Herr Dr. " in new[1]
    one, two, three = (new[1].split(x)[1] for x in ("Mr ", ", then Mr ", " and Mrs "))
    family = two.split(" and ")[0]
    assert one.split(",")[0].split()[-1] == family == three.split("'s")[0] and one.split()[0] in pii.NAMES["m"]["latin"]
    tolkien = [new[0].rstrip(".").split()[-1], new[1].split("'s")[0].split()[-1]]
    assert tolkien[0] == tolkien[1]
    cards = new[2].removeprefix("cards ").split(", order")[0]
    first, second = cards.split(" or ")[0], cards.split(" or ")[1].split(", ")[0]
    assert luhn(first) and len(first) == 15 and second.replace(" ", "") == first and second[4] == second[11] == " "
    assert "6011000990139424123" in new[2] and new[2].endswith("order 378282246310006 and time 1700000000000")
    assert "db8" not in new[3].lower() and "7334" not in new[3] and new[3].endswith(" at 10:30:15, std::vector") and new[3].count("::") == 3
    a, b, rest = new[4].split(" and ")
    assert iban_holds(a) and a.startswith("GB") and iban_holds(b) and b.startswith("DE") and "WEST" not in a and luhn(rest.split()[0])
    assert rest.split(" ", 1)[1].replace(" ", "") == rest.split()[0]
    other = [r.text for r in pii.pii_report(d, "another key").orderBy("doc_id").collect()]
    assert all(x != y for x, y in zip(new, other, strict=True))


def test_no_entity_is_left(spark):
    """Random entities of all kinds, names in six scripts: none stands in the new texts, distinct ones stay distinct, equal ones
    equal, and what is around them stays."""
    rng = random.Random(11)
    scripts = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπρστ", "աբգդեզէըթժիլխծկհ", "àáâäçèéêëìíîïñòóôö", "şğıčšžřůąę"]
    word = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    digits = lambda n: word("0123456789", n)

    def name():
        s = rng.choice(scripts)
        return " ".join(word(s, rng.randint(4, 9)).capitalize() for _ in range(rng.randint(1, 3)))

    makers = {
        "name": lambda: rng.choice(["Mr ", "Mrs ", "Dr. ", "Господин "]) + name(), "email": lambda: f"{word(scripts[rng.randrange(6)], 8)}.{digits(3)}@{word(scripts[0], 6)}.com",
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "phone": lambda: f"+1 {digits(3)} {digits(3)} {digits(4)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "ip6": lambda: ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(7)) + f":{rng.randrange(10)}", "card": lambda: digits(16), "iban": lambda: f"DE{digits(20)}",
    }
    entities = sorted({m() for m in makers.values() for _ in range(40)})
    texts = [(i, f"before {e}; between {entities[(i * 7) % len(entities)]}, after") for i, e in enumerate(entities)]
    got = {r.doc_id: r.text for r in pii.pii_report(spark.createDataFrame(texts, "doc_id long, text string"), "k").collect()}
    assert not [e for e in entities for t in got.values() if e in t]
    first, second = {}, {}
    for i, t in got.items():
        assert t.startswith("before ") and t.endswith(", after") and "; between " in t, t
        first[entities[i]], second[entities[(i * 7) % len(entities)]] = t[7:-7].split("; between ")
    assert len(set(first.values())) == len(entities) and all(first[e] == x for e, x in second.items())
    parts = {w for e in entities if e[0] in "MDГ" for w in e.split()[1:]}
    assert not parts & {w for t in got.values() for w in t.replace(",", " ").replace(";", " ").split()}


def test_texts_without_a_match_are_not_shuffled(spark):
    d = spark.createDataFrame([(1, "nothing here"), (2, "Mr Smith")], "doc_id long, text string")
    plan = pii.pseudonymise(d, "k")[0]._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Union", 1)[1].strip().splitlines()
    assert any("NOT" in x and "RLIKE" in x for x in top) and plan.count("Join") >= 1


def luhn(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_surrogates(spark, docs, none):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)] + [(1, PRIVATE[1])], "doc_id long, text string")
    rows = pii.pii_report(d, "k").collect()
    assert len(rows) == 9
    got = {r.doc_id: r for r in rows}
    new = {i: r.text for i, r in got.items()}
    assert [got[i].n_entities for i in range(8)] == [2, 3, 3, 4, 0, 2, 0, 0]
    assert new[4] == PRIVATE[4] and new[6] is None and new[7] == ""
    mails = [w for w in new[0].split() if "@" in w]
    assert mails[0] == mails[1] and mails[0] in new[5] and mails[0].endswith(".example") and "anna" not in mails[0]
    cards = new[1].removeprefix("card ").split(", again ")
    assert cards[0].replace(" ", "") == cards[1].split(" ")[0] and luhn(cards[0]) and cards[0] != "4539 1488 0343 6467"
    phones = new[2].split("; ")[0].split(" vs ")
    assert "".join(filter(str.isdigit, phones[0])) == phones[1][1:] and phones[0][:4] == "+1 (" and phones[1] != "+15215556210"
    names = new[3]
    assert names.startswith("Frau ") and "Müller" not in names and "Doe" not in names and "Иванов" not in names
    second, third = names.split(" and ")[1].split(" met ")
    assert second.split()[1] in pii.NAMES["f"]["latin"] and third.split()[1] in pii.NAMES["m"]["latin"]
    assert pii.pii_report(docs, "k").count() == docs.count() and pii.pii_report(none, "k").count() == 0
    out, name = pii.pseudonymise(clashing(docs), "k")
    assert out.columns == [*clashing(docs).columns, name["new_text"], name["n_entities"]]


def test_surrogates_stay_distinct(spark, monkeypatch):
    ips = [f"{a}.{b}.1.1" for a in range(1, 41) for b in range(40)]
    d = spark.createDataFrame([(i, f"from {x} on") for i, x in enumerate(ips)], "doc_id long, text string")
    from_few = lambda kind, norm, d_, family, more: F.concat(F.lit("9.9.9."), (F.element_at(d_, 2) % 8000).cast("string"))
    monkeypatch.setattr(pii, "_surrogate", from_few)  # a space so small that draws collide
    new = [r.text for r in pii.pii_report(d, "k").collect()]
    assert len(set(new)) == len(ips)


# backoff


def test_backoff(spark, docs, edges, none):
    rows = [(i, t) for i, t, *_ in edges]
    want = Counter((i, len(brute.alnum(t)), round(x, 5) if brute.alnum(t) else None) for (i, t), x in zip(rows, brute.backoff(rows), strict=True))
    kept = stored(docs, "docs")
    got = backoff.score_documents(clashing(kept)).collect()
    assert Counter((r.doc_id, r.n_words, None if r.log_score is None else round(r.log_score, 5)) for r in got) == want
    assert backoff.score_documents(none).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert backoff.score_documents(one).collect()[0].n_words == 3


def test_small_counts_pack():
    x = np.array([0, 1, 254, 255, 256, 10**12])
    assert backoff._unpack_small(backoff._pack_small(x), len(x)).tolist() == x.tolist()


# toxicity


def test_windows_cover():
    for n in range(200):
        got = toxicity.windows_of(n)
        assert {i for s in got for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_gradients():
    rng = np.random.default_rng(1)
    words = [b"ab", b"abc", b"x", b"longer", b"longest"]
    h, _ = toxicity._grams(words)
    net = toxicity.Network({w: i + 1 for i, w in enumerate(words[:3])}, np.unique(h))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    found = net.lookup(words)
    ids = rng.integers(0, 5, (6, 4))
    mask = np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    y = np.array([1.0, 0, 1, 0])

    def loss():
        z = net.forward(net.inputs(net.compose(found)), ids, mask)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    x = net.compose(found)
    proj, keep = net.inputs(x), {}
    z = net.forward(proj, ids, mask, keep)
    g, dx = net.gradients(proj, ids, mask, keep, 1 / (1 + np.exp(-z)) - y, x)
    for k in g:
        at = tuple(rng.integers(0, n) for n in net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at])), k


def test_scores_against_plain_loops():
    """Whole texts, word by word, unit by unit."""
    rng = random.Random(6)
    texts = [prose(rng, n).encode() for n in (1, 2, 31, 32, 33, 70, 400)] + ["Ünïcode wörds".encode()]
    vocabulary = sorted({w for t in texts for w in t.split()})[::2]
    net = toxicity.Network({w: i + 1 for i, w in enumerate(vocabulary)}, np.unique(toxicity._grams(vocabulary)[0]))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    known = {int(h): i for i, h in enumerate(net.gram_hashes)}

    def vector(w):
        h, _ = toxicity._grams([w])
        slots = [net.slot[int(x) & (toxicity.SLOTS - 1)] for x in h]
        own = [p["gram"][i] for x, i in zip(h, slots, strict=True) if i and known.get(int(x)) == i]
        return p["word"][net.words.get(w, 0)] + sum(own, np.zeros(toxicity.DIM)) / max(1, len(h))

    def states(xs, d):
        h, out, k = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            a, g = x @ p[f"in_{d}"] + p[f"bias_{d}"], h @ p[f"re_{d}"]
            z, r = sigmoid(a[:k] + g[:k]), sigmoid(a[k : 2 * k] + g[k : 2 * k])
            n = np.tanh(a[2 * k :] + r * g[2 * k :])
            h = n + z * (h - n)
            out.append(h)
        return out

    def score(t):
        xs = [vector(w) for w in toxicity.alnum_words(t)]
        best = 0.0
        for s in toxicity.windows_of(len(xs)):
            part = xs[s : s + toxicity.WINDOW]
            both = [np.concatenate(x) for x in zip(states(part, "f"), states(part[::-1], "b")[::-1], strict=True)]
            e = np.array([np.tanh(x @ p["attend"]) @ p["v"] for x in both])
            a = np.exp(e - e.max())
            pooled = sum(w * x for w, x in zip(a / a.sum(), both, strict=True))
            best = max(best, float(sigmoid(pooled @ p["u"] + p["b"][0])))
        return best

    assert np.allclose(toxicity.Scorer(net).score(texts), [score(t) for t in texts], atol=1e-5)
    assert toxicity.Scorer(net).score([b"", b" "]) == [0, 0]


def test_toxicity_learns(spark, none):
    rng = random.Random(4)
    bad = ["vileword", "nastyword", "foulstem"]
    rows, labels = [], []
    for i in range(500):
        w = prose(rng, rng.randint(5, 120)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(None, "vileword"), (900, None), (901, ""), (902, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(clashing(d), lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert by[900].score == by[901].score == by[902].score == 0
    assert toxicity.toxicity_report(none, lab).count() == 0
    assert {r.score for r in toxicity.toxicity_report(d.limit(3), lab.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("rest", [3, 4])
def test_backoff_tells_hashes_apart(rest):
    """N-grams whose hashes agree in the upper 32 and the last 8 bits sent keep their own counts."""
    assert backoff.rest_bytes(10**8) == 3 and backoff.rest_bytes(10**10) == 4 and backoff.rest_bytes(0) >= 1
    low = np.array([0x107, 0x207, 0xFFFF07 if rest == 3 else 0xFFFFFF07, 0x107], np.uint64)
    codes = np.array([5, 5, 5, 6], np.uint64) << np.uint64(32) | low << np.uint64(8 * (4 - rest))
    packed = [backoff._pack_codes((x >> np.uint64(32)).astype(np.uint32), x, np.full(len(x), t), rest) for x, t in ((codes[:3], 1), (codes[1:], 300))]
    got = backoff._joiner(rest)(pa.table({"bucket": [0, 0], "block": [1, 2], "packed": pa.array(packed, pa.binary())}))
    totals = [backoff._unpack_small(zstandard.ZstdDecompressor().decompress(v), n).tolist() for v, n in zip(got["packed"].to_pylist(), got["n"].to_pylist(), strict=True)]
    assert totals == [[1, 301, 301], [301, 301, 300]]
