import pytest
from oracle import compare

from helioscape.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    assert compare(df, con, ORACLES[name]) is None
    assert df.take(1)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
