"""Every query of the engine against its oracle."""

import pytest
from helpers import normal, oracle

from blockwright import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = oracle(catalogue.ORACLE_SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
