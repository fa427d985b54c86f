"""Every registered query against its SQL at sf0.01, and the driver contract."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference
from twinsift.plans import load_all

FOLDER = "/root/testdata/sf0.01"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_matches_sql(spark, con, name):
    q = REGISTRY[name]
    assert q.sql, "every query states its result in SQL"
    assert difference(q.run(spark, FOLDER), con, q.sql) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    ranked = contract.entry(spark).collect()
    assert len(ranked) == 313
    priors = [r["lookalike_prior"] for r in ranked]
    assert priors == sorted(priors, reverse=True)
