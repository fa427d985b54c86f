"""Queries whose result once changed in kind with the size of the tables, at sf0.1."""

import pytest

from tests.compare import connect, difference
from twinsift.plans import load_all

FOLDER = "/root/testdata/sf0.1"
REGISTRY = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["split_assign", "split_sizes", "geodesic_error", "split_gap", "leak_flag"])
def test_matches_sql(spark, con, name):
    q = REGISTRY[name]
    assert difference(q.run(spark, FOLDER), con, q.sql) is None


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", FOLDER])
def test_every_split_has_rows(spark, folder):
    rows = REGISTRY["split_assign"].run(spark, folder).groupBy("split").count().collect()
    assert {r["split"] for r in rows} == {"train", "test_random", "test_heldout_region", "test_heldout_species"}


def test_task_functions_travel_with_their_code(spark):
    """Workers need not have the package: what runs in tasks is pickled by value."""
    from pyspark import cloudpickle
    from twinsift.operators import similarity
    blob = cloudpickle.dumps(similarity._best_of_block_pairs)
    assert b"_class_maxima" in blob and b"reduceat" in blob
