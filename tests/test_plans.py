"""What plans must not do on large tables."""

import os

import pytest

from sluice.plans import catalog, relations
from tests.conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["line_findings", "validated_lines", "committed_prices", "page_packages"])
def test_lines_are_not_dealt_by_a_few_values(spark, name):
    """Small tables go to the lines; lines of one category, section or file are no task's."""
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_parts_follow_the_table(spark):
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    assert relations.dealt(spark, SF, "lineitem", "l_orderkey", each=1024).rdd.getNumPartitions() == -(-size // 1024)
    assert relations.dealt(spark, SF, "lineitem", "l_orderkey", each=size).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["title_block_sheets", "note_glossary"])
def test_items_are_dealt_before_they_are_many(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
