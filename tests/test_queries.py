"""Every query of the engine against its SQL, or for a result of sound shape."""

import pytest

from compare import check, connect
from kairoframe.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, tables, name):
    check(QUERIES[name](spark, SF), tables, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1
