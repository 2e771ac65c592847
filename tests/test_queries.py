"""Every registered query of the library against its SQL on the smallest tables; the others run and give rows."""

import pytest

from siltstone.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, small, duck, same, name):
    same(QUERIES[name](spark, small), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"url_host", "host_aborts"} <= set(e.queries())
    assert e.entry(spark).count() > 0
