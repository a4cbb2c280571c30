"""Every registered query of the engine runs, and gives what its SQL gives."""

import pytest

from tessella.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(same_rows, name):
    same_rows(catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
