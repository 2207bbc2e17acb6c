"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from workload import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert name in SQL, "every query has SQL"
    assert oracle.difference(df, con, SQL[name]) is None
