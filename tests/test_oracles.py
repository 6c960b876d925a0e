"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


def _names():
    from marquee.plans import QUERIES

    return list(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query(spark, con, name):
    from marquee.plans import ORACLES, QUERIES

    status, _, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert status in ("ok", "rows"), note


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
