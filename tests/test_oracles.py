"""Every catalogue query against its DuckDB oracle; those without one must run and give rows."""

import os

import pytest

from tests import oracle
from tilespark.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables here")
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, oracle.SF)
    if name in ORACLES:
        oracle.check(con, df, ORACLES[name])
    else:
        assert df.count() > 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
