"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest

from tesserae import plans

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert_same(plans.queries()[name](spark, sf_dir), plans.oracle_sql()[name], sf_dir)


def test_registry(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
