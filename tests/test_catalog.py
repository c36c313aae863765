"""Each query of the engine against its SQL twin."""

import pytest

from heronlake.plans import catalog
from tests.oracle import connection, mismatch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sql, name):
    assert mismatch(catalog.QUERIES[name](spark, SF), sql, catalog.ORACLES[name]) is None


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
