"""Every registered query against its SQL."""

import pytest

from braidframe.plans.registry import ORACLE_SQL, QUERIES
from compare import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert_same(df, con, ORACLE_SQL[name])
    else:
        assert df.count() >= 0
