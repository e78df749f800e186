"""The queries that SQL can express, against it."""

import pytest
from compare import differences

from folioflow.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), sf, ORACLE_SQL[name]) == []


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
