import pytest

from sluice.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 18
