"""Every query of the library against its SQL, or that it runs."""

import pytest
from oracle import assert_same, connect

from bidscout.plans.registry import ORACLES, QUERIES

CON = {}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLES:
        con = CON.setdefault(sf, connect(sf))
        assert_same(spark, con, sf, name, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
