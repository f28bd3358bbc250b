"""Every registered query against its SQL oracle, or for rows, on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import database, difference

FOLDER = "/root/testdata/sf0.001"
PLANS, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("key", sorted(PLANS))
def test_query(spark, con, key):
    df = PLANS[key](spark, FOLDER)
    if key in ORACLES:
        outcome = difference(df, con, ORACLES[key])
        assert outcome is None, outcome
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(PLANS)
