"""Every registered query against its SQL on the smallest sample tables."""

import pytest

from reelgraph.plans import CATALOG
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, CATALOG[name], SF_DIR) is None


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
