import pytest

import __spark_entry__ as entry
from waymark.plans.oracles import ORACLE_SQL
from waymark.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
