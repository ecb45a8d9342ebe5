"""Every registered query runs on the smallest tables; those with an oracle must equal it."""

import pytest
from oracle import compare, connect

from sightline.catalog import oracles, queries

SF = "/root/testdata/sf0.001"
ORACLES = oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    assert len(got.columns) > 0
    if name in ORACLES:
        assert compare(got, duck.sql(ORACLES[name]).df()) is None


def test_oracles_name_queries():
    assert set(ORACLES) <= set(queries())
