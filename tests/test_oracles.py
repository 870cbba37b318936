"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import oracle
import pytest

from trajet.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        oracle.compare(spark, QUERIES[name], ORACLES[name], SF, con)
    else:
        assert QUERIES[name](spark, SF).count() > 0
