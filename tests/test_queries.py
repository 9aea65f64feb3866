"""Every registered query of the library against its SQL oracle."""

import pytest

from strandwork.plans import canvases, catalog, clips, frames, likeness, manifests, rasters, regions, sheets, stores, values  # noqa: F401
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())

