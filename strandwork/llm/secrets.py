"""Secret scans with a randomness test battery, in native column expressions.

Base spans come from three patterns. Besides, each maximal run of 20 or more token characters gets an inferred
encoding (hex, base32, base36, base52, base62 or base64; a run must mix character classes) and three tests of the
hypothesis that its characters are uniform and independent: chi-squared over the encoding's alphabet (with the exact
mean and variance that it has at the run's length), runs above and below the alphabet's middle, and serial correlation
at lag one. Fisher's method combines them into one p-value.

A discovery is a run that is reported as random, a span of kind ``random``; a false one is an identifier, path or word
among these. Random runs have uniform p-values, so those over one half, doubled, estimate their number in a band of
lengths, and what is reported beyond their share counts as false. In each band the runs with the largest p-values are
reported, as many as keep that share under the band's rate (short runs, on which the tests have little power, get the
larger one), but none with a p-value under a thousandth, where no more than that share of the random ones is left. A
random run is missed only if its p-value lies under the cut. Runs that aren't random but have p-values
over one half can't be told from random ones, by this or by any use of the tests.

The p-values meet as counts in buckets of a hundredth of a decade (at most ``BUCKETS`` a band), so the procedure over
all documents needs one small aggregate and never orders the candidates themselves.

Defined results: null text is empty; empty texts have no spans. Places are code points, end exclusive. Rows with equal
or null ids are scanned each on its own; repeated rows and ties are reported alike. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.llm.common import stored, whole

#: Kind, pattern, least length, and the group whose length counts.
KINDS = [
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]+", 24, 0),
]
#: A run of at least so many characters of one class matches where the open pattern does, so short runs need no list.
_SEARCH = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Upper length of a band (exclusive) and the share of false ones among the runs that are reported.
BANDS = [(32, 0.20), (64, 0.10), (1 << 31, 0.05)]
BUCKETS = 900
#: The last bucket of p-values over about one half, and of those over a thousandth.
UPPER, LAST = 30, 299
_SPAN = "array<struct<start:int,end:int,m:string>>"


def _running(lengths: Column) -> Column:
    """Running sums of an array, by doubling: each step adds what stands 1, 2, 4 ... places before."""
    steps = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int")
    add = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2.0), k).cast("int")), F.lit(0)))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lengths, add)).otherwise(lengths)


def _places(text: Column, pattern: str) -> Column:
    """Structs (start, end, m) of the leftmost non-overlapping matches: the pieces between them give the places.

    The places are running sums over gaps and matches, so a text of many matches takes n log n steps.
    """

    def spans(found: Column) -> Column:
        matches, pieces = found["m"], found["p"]
        lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
        ends = _running(lengths)
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(pattern), _let(found, spans)).otherwise(F.array().cast(_SPAN))


def _meets(spans: Column, t: Column) -> Column:
    """Whether one of the spans, which are in order and apart, overlaps t: the first that ends behind t's start, by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        move, before = s["low"] < s["high"], F.get(spans, middle)["end"] <= t["start"]
        return F.struct(F.when(move & before, middle + 1).otherwise(s["low"]).alias("low"), F.when(move & ~before, middle).otherwise(s["high"]).alias("high"))

    first = F.aggregate(steps, start, halve, lambda s: F.get(spans, s["low"]))
    return F.coalesce(first["start"] < t["end"], F.lit(False))


def _normal_tail(z: Column) -> Column:
    """P(N > z) for any z, by Abramowitz and Stegun 7.1.26."""
    return _let(z, _tail)


def _tail(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def _encoding(m: Column) -> Column:
    body = F.regexp_replace(m, "=+$", "")
    digit, upper, lower = body.rlike("[0-9]"), body.rlike("[A-Z]"), body.rlike("[a-z]")
    return (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digit & (upper | lower), "hex")
        .when(body.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
        .when(body.rlike("^([a-z0-9]+|[A-Z0-9]+)$") & digit & (upper | lower), "base36")
        .when(body.rlike("^[A-Za-z]+$") & upper & lower, "base52")
        .when(body.rlike("^[A-Za-z0-9]+$") & digit & upper & lower, "base62")
        .when(digit & upper & lower & ~m.rlike("[^=]=+[^=]"), "base64")
    )


def battery(m: Column) -> Column:
    """Struct (encoding, p_chi, p_runs, p_serial, p) of a token; null where no encoding is inferred."""
    enc = _encoding(m)
    body = F.translate(F.regexp_replace(m, "=+$", ""), "-_", "+/")
    body = F.when(enc.isin("hex", "base36"), F.lower(body)).otherwise(body)
    alphabet = F.element_at(F.create_map([F.lit(x) for kv in ALPHABETS.items() for x in kv]), enc)
    x = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c).cast("double") - 1)  # instr: 1 is the first
    first = F.struct(enc.alias("encoding"), x.alias("x"), F.length(alphabet).cast("double").alias("k"), F.size(x).cast("double").alias("n"))
    return F.when(enc.isNotNull(), _let(_let(_let(first, _sums), _moments), _p_values))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _kept(v: Column, *names: str) -> list[Column]:
    return [v[n].alias(n) for n in names]


def _sums(v: Column) -> Column:
    x, k = v["x"], v["k"]
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)).cast("double"), F.lit(2.0)))
    high = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y >= k / 2).cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / v["n"]
    before, after = F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1)
    turns = F.aggregate(F.zip_with(before, after, lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double")), F.lit(0.0), lambda a, y: a + y)
    return F.struct(*_kept(v, "encoding", "x", "k", "n"), squares.alias("squares"), high.alias("high"), mean.alias("mean"), (1 + turns).alias("runs"))


def _moments(v: Column) -> Column:
    x, k, n, mean = v["x"], v["k"], v["n"], v["mean"]
    spread = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
    before, after = F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1)
    serial = F.aggregate(F.zip_with(before, after, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, y: a + y)
    chi = F.greatest(v["squares"] * k / n - n, F.lit(0.0))
    spare = 2 / (9 * (k - 1) * n / (n - 1))  # the statistic's variance over n independent places is (n - 1) / n of chi-squared's
    z_chi = (F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - spare)) / F.sqrt(spare)  # Wilson and Hilferty
    mu = 1 + 2 * v["high"] * (n - v["high"]) / n
    return F.struct(*_kept(v, "encoding", "n", "runs"), z_chi.alias("z_chi"), mu.alias("mu"), ((mu - 1) * (mu - 2) / (n - 1)).alias("var"), spread.alias("spread"), serial.alias("serial"))


def _p_values(v: Column) -> Column:
    tiny = F.lit(1e-9)
    clip = lambda p: F.least(F.greatest(p, tiny), F.lit(1.0))
    p_runs = F.when(v["var"] > tiny, 2 * _normal_tail(F.abs((v["runs"] - v["mu"]) / F.sqrt(F.greatest(v["var"], tiny))))).otherwise(tiny)
    p_serial = F.when(v["spread"] > tiny, 2 * _normal_tail(F.abs(v["serial"] / F.greatest(v["spread"], tiny) * F.sqrt(v["n"])))).otherwise(tiny)
    three = F.struct(v["encoding"].alias("encoding"), clip(_normal_tail(v["z_chi"])).alias("p_chi"), clip(p_runs).alias("p_runs"), clip(p_serial).alias("p_serial"))
    return _let(three, _fisher)


def _fisher(v: Column) -> Column:
    half = -(F.log(v["p_chi"]) + F.log(v["p_runs"]) + F.log(v["p_serial"]))  # the statistic over two; 6 degrees of freedom
    return _let(
        F.struct(*_kept(v, "encoding", "p_chi", "p_runs", "p_serial"), half.alias("h")),
        lambda w: F.struct(*_kept(w, "encoding", "p_chi", "p_runs", "p_serial"), F.greatest(F.exp(-w["h"]) * (1 + w["h"] + w["h"] * w["h"] / 2), F.lit(1e-9)).alias("p")),
    )


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS) - 1)
    for i in range(len(BANDS) - 2, -1, -1):
        out = F.when(length < BANDS[i][0], i).otherwise(out)
    return out


def reported_to(candidates: DataFrame) -> dict[int, int]:
    """For each band the last bucket that is reported as random. candidates: band, bucket.

    Of the runs up to a bucket, those beyond the random ones expected there are false: as many random runs as the upper
    buckets hold at their share of the unit interval, less what falls below the bucket.
    """
    count = candidates.groupBy("band", "bucket").agg(F.count("*").alias("n"))  # at most len(BANDS) * (BUCKETS + 1) rows
    by = W.partitionBy("band")
    rate = F.element_at(F.array([F.lit(q) for _, q in BANDS]), F.col("band") + 1)
    below = F.when(F.col("bucket") < BUCKETS, F.pow(F.lit(10.0), -(F.col("bucket") + 1) / 100)).otherwise(0.0)
    random = F.sum(F.when(F.col("bucket") <= UPPER, F.col("n")).otherwise(0)).over(by) / (1 - 10 ** (-(UPPER + 1) / 100))
    ranked = count.select("band", "bucket", rate.alias("rate"), F.sum("n").over(by.orderBy("bucket")).alias("upto"), (random * (1 - below)).alias("random"))
    last = ranked.where(F.col("bucket") <= LAST).where(1 - F.col("random") / F.col("upto") <= F.col("rate")).groupBy("band").agg(F.max("bucket").alias("b"))
    return {r.band: r.b for r in last.collect()}  # one row a band


def _tagged(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["m"].alias("m")),
    )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, and an array of structs (start, end, kind rank, kind, m) by start, then rank."""
    text = whole("text")
    found = docs.select("doc_id", text.alias("t")).select("doc_id", *[_places(F.col("t"), _SEARCH[k]).alias(k) for k, *_ in KINDS], _places(F.col("t"), TOKEN).alias("tokens"))
    assign = F.filter("assign", lambda s: F.length(F.regexp_extract(s["m"], KINDS[0][1], 2)) >= KINDS[0][2])
    tagged = [_tagged(assign if k == "assign" else F.col(k), i, k) for i, (k, *_) in enumerate(KINDS)]
    base = F.array_sort(F.concat(*tagged))
    rows = found.withColumn("assign", assign).select("doc_id", base.alias("base"), *[k for k, *_ in KINDS], "tokens")
    free = F.filter("tokens", lambda t: ~(_meets(F.col("assign"), t) | _meets(F.col("access"), t) | _meets(F.col("hex"), t)))
    rows = rows.withColumn("free", F.when((F.size("tokens") > 0) & (F.size("base") > 0), free).otherwise(F.col("tokens"))).drop("tokens", *[k for k, *_ in KINDS])
    tested = F.transform("free", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["m"].alias("m"), battery(t["m"]).alias("r")))
    tested = F.filter(tested, lambda t: t["r"].isNotNull())
    bucket = lambda p: F.least(F.floor(-F.log10(p) * 100), F.lit(BUCKETS)).cast("int")
    judged = F.transform(
        tested,
        lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["m"].alias("m"), _band(F.length(t["m"])).alias("band"), bucket(t["r"]["p"]).alias("bucket")),
    )
    rows = stored(rows.select("doc_id", "base", F.when(F.size("free") > 0, judged).otherwise(F.array().cast("array<struct<start:int,end:int,m:string,band:int,bucket:int>>")).alias("judged")), "secrets")
    last = reported_to(rows.select(F.explode("judged").alias("j")).select("j.band", "j.bucket"))
    limits = F.array([F.lit(last.get(i, -1)) for i in range(len(BANDS))])
    random = _tagged(F.filter("judged", lambda j: j["bucket"] <= F.element_at(limits, j["band"] + 1)), len(KINDS), "random")
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    rows = scan_secrets(docs.select("doc_id", "text"))
    n = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return rows.select(
        "doc_id",
        *[n(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def place_report(docs: DataFrame) -> DataFrame:
    """What the base patterns find, without the battery's own spans."""
    return secret_report(docs).drop("spans")


_MARK = "chr(1114109)"  # in no text: the last private character
_KINDS = [  # as the contract has them, failing matches dropped afterwards
    ("assign", KINDS[0][1].replace("'", "''")),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
]
#: The same rows of the base patterns in DuckDB's SQL: marks around all matches, and running lengths of what lies between.
PLACE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(f"SELECT rid, {i} AS rank, '{k}' AS kind, string_split(regexp_replace(t, '{p}', {_MARK} || '\\0' || {_MARK}, 'g'), {_MARK}) AS parts FROM d" for i, (k, p) in enumerate(_KINDS))}),
u AS (SELECT rid, rank, kind, unnest(parts) AS m, unnest(range(len(parts))) AS i FROM k),
r AS (SELECT *, sum(length(m)) OVER (PARTITION BY rid, rank ORDER BY i) AS upto FROM u),
b AS (SELECT *, (upto - length(m))::BIGINT AS s, upto::BIGINT AS e FROM r
      WHERE i % 2 = 1 AND CASE rank WHEN 0 THEN length(regexp_extract(m, '{_KINDS[0][1]}', 2)) >= 6 WHEN 1 THEN length(m) >= 20 ELSE length(m) >= 24 END),
g AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, (k, _) in enumerate(_KINDS))} FROM b GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _ in _KINDS)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)
"""
