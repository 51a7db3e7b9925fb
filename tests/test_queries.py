"""Every query of the library gives the rows of its SQL."""

from __future__ import annotations

import pytest

from workpulse.plans import registry

from .conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_rows_equal_sql(spark, small, duck, name):
    found = rows_of(registry.QUERIES[name](spark, small))
    if name in registry.SQL:
        assert found == rows_of_sql(duck, registry.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
