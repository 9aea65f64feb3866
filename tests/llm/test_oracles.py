"""Queries against their SQL: on the small tables, on rows with nulls, ties, repeats and long texts, and on no rows.

For SQL that walks windows or pairs the long texts of the edge rows are cut to some hundred words; the operators meet them
whole in their own tests.
"""

import os
import random

import pytest

from strandwork.llm import queries
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_text_rules import SECRETS
from tests.oracle import check, views

SF = "/root/testdata/sf0.001"


#: Queries whose SQL takes minutes on very long texts.
SHORT = ["op3_decontamination", "op6_quality_rules", "op8_jaccard_join", "quality_ablations"]
WHOLE = sorted(set(queries.ORACLES) - set(SHORT))


def planted():
    """Secrets of all kinds, licence phrases (cut, doubled, at both ends), and sources of very unlike sizes."""
    rng = random.Random(8)
    some = [t for t in SECRETS if t]
    texts = SECRETS + ["\n".join(some), "ключ " + "😀é " * 3 + " ".join(some)]
    texts += ["MIT License", "the license", "license MIT license license", "general public license GNU General  Public\tLicense", "Apache-License, apache 2 license", "public license mit", "é mit license 東京 apache license"]
    rows = [(t, "rare") for t in texts] + [(prose(rng, 400), "hot") for _ in range(40)] + [(prose(rng, 60), f"s{i % 5}") for i in range(30)] + [("one", "tiny"), ("two", None)]
    return [(i, t, "en", source, None) for i, (t, source) in enumerate(rows)]


PLANTED = ["license_places", "secret_places", "source_weights", "op2_lm_scoring", "op12_importance_resampling"]


@pytest.fixture(scope="module")
def folders(spark, edges, tmp_path_factory):
    """Folders of tables: the small ones, the edge rows as documents, the same with shorter texts, and no documents."""
    out = {"small": SF}
    short = [(i, t if t is None else t[:1500], *rest) for i, t, *rest in edges]
    for name, rows in (("edges", edges), ("short", short), ("planted", planted()), ("empty", [])):
        out[name] = str(tmp_path_factory.mktemp(name))
        for t in os.listdir(SF):
            os.symlink(f"{SF}/{t}", f"{out[name]}/{t}") if t != "documents.parquet" else spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out[name]}/{t}")
    return out


@pytest.mark.parametrize(("name", "folder"), [(n, f) for n in WHOLE for f in ("small", "edges", "empty")] + [(n, f) for n in SHORT for f in ("small", "short", "empty")] + [(n, "planted") for n in PLANTED])
def test_oracle(spark, folders, name, folder):
    check(spark, queries.QUERIES[name], queries.ORACLES[name], folders[folder])


def test_planted_rows_are_found(folders):
    """The SQL itself finds every kind, and both limits of the weights bind."""
    con = views(folders["planted"])
    assert all(n > 0 for n in con.execute(f"SELECT sum(n_assign), sum(n_access), sum(n_hex) FROM ({queries.ORACLES['secret_places']})").fetchone())
    assert con.execute(f"SELECT sum(n_base), count(DISTINCT base_labels) FROM ({queries.ORACLES['license_places']})").fetchone() == (7, 5)
    tokens, target = zip(*con.execute(f"SELECT tokens, target FROM ({queries.ORACLES['source_weights']})").fetchall(), strict=True)
    assert 3.9 < max(b / a for a, b in zip(tokens, target, strict=True)) <= 4 and min(b / a for a, b in zip(tokens, target, strict=True)) < 1
