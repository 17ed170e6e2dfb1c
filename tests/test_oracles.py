"""Every query with an oracle must equal it on the smallest tables."""

import pytest

from catalog import ORACLES, QUERIES
from tests.oracle_check import differences, duck

# These train models; test_model.py covers them.
SLOW = {n for n in QUERIES if n in __import__("catalog.model", fromlist=["QUERIES"]).QUERIES and n not in ORACLES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name in ORACLES:
        assert differences(got, con.execute(ORACLES[name]).to_arrow_table()) == []
    else:
        assert got.num_rows > 0
