import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(6)]
    texts = [None, "", "  \n\t ", "one", "Two words", "one two three four", "ONE two three FOUR", "a b c d e", "a b c d e f"]
    texts += base + base[:3]
    for t in base:
        w = t.split()
        for share in (0.02, 0.05, 0.2):
            x = list(w)
            for _ in range(max(1, int(share * len(w)))):
                x[rng.randrange(len(x))] = "zz%d" % rng.randrange(9)
            texts.append(" ".join(x))
    texts += [" ".join([base[0]] * 2), prose(rng, 30_000), "\n".join([base[1], base[2], base[1]]), "Ünïcode ÉÉ wörds — naïve 東京 text " * 4]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(None, base[4], None, None, None), (3, "one", "en", "s0", 3), (3, "one", "en", "s0", 3), (7, base[5], None, "s1", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edges():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, edges):
    return spark.createDataFrame(edges, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    from pyspark.sql import functions as F

    for c in ("n_words", "measures", "fail_bits", "key", "hits", "block", "new_text", "n_removed", "at", "score", "kept_id", "own_key", "row_key"):
        df = df.withColumn(c, F.lit("mine"))
    return df
