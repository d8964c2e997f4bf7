"""Every registered query with a SQL text gives the same rows as that text."""
import pytest

import __spark_entry__ as entry
from oracle import compare

ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf, name):
    problem = compare(entry.queries()[name](spark, sf), con, ORACLES[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "mean" in df.columns
