import pytest

from sluice.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 14))
