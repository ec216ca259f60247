"""The registered queries on the smallest tables: against SQL where there is some, and that they run."""

import oracle
import pytest

from sparkloom.llm import queries

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert oracle.difference(df, con, SQL[name]) is None
    else:
        assert df.count() >= 0


def test_columns(spark):
    want = {
        "p1_found": [("id", "bigint")], "p2_found": [("id", "bigint"), ("line_no", "int")], "p3_found": [("key_a", "string"), ("key_b", "string")], "p4_found": [("id_a", "bigint"), ("id_b", "bigint")], "p5_found": [("id", "bigint")],
        "p6_found": [("id", "bigint"), ("line_no", "int")], "p7_found": [("id", "bigint")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p10_found": [("doc_id", "bigint")],
    }
    assert {n: QUERIES[n](spark, SMALL).dtypes for n in want} == want
