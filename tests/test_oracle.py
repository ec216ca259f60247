"""Every core query with SQL gives what DuckDB gives on the smallest tables; the others run."""

import oracle
import pytest
from oracle import SMALL

from sparkloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert oracle.difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
