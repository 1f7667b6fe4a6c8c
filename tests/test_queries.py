import pytest
from oracle import agree

import maskwright.plans.queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, SF, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).toPandas().columns.size > 0
