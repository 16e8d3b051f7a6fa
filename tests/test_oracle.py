"""Every registered query against its DuckDB equivalent on the smallest tables."""

import pytest

from check_oracle import compare, connect
from relaylens.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_reference_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("key", sorted(catalogue.queries()))
def test_query(spark, duck, key):
    assert compare(spark, duck, key, SF_DIR) is None
