"""Every registered query of the library's own operators against its SQL check on the driver's tables."""

import pytest
from compare import difference, duck

from __spark_entry__ import entry, oracle_sql, queries
from patchlens.plans.oracles import ORACLES
from patchlens.plans.queries import QUERIES

SLOW = {"routed_reviews"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: (n in SLOW, n)))
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["query_id", "framework", "rank", "element_id", "score"]
    assert rows.count() > 0
