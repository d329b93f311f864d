"""What physical plans must and must not hold."""

import pytest

from ledgerloom.plans import core_queries, table_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p5_found", "p6_found", "p6_sessions", "compact_stats", "sk_index", "batch_find_by_sk_paged"])
def test_no_cross_joins(spark, data, name):
    p = plan({**core_queries.QUERIES, **table_queries.QUERIES}[name](spark, data))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scans_read_the_columns_they_need(spark, data):
    p = plan(core_queries.p6_found(spark, data))
    assert "ReadSchema: struct<ts:bigint,username:string>" in p and "IsNotNull(username)" in p
    p = plan(table_queries.get_by_pk(spark, data))
    assert "EqualTo(c_custkey,7)" in p and "Exchange" not in p


def test_hot_keys_are_reduced_before_the_shuffle(spark, data):
    p = plan(table_queries.log_latest_state(spark, data))
    assert p.count("WindowGroupLimit") == 2
    assert plan(core_queries.p5_found(spark, data)).count("MapInArrow") == 2


def test_paging_is_a_top_k(spark, data):
    assert "TakeOrderedAndProject" in plan(table_queries.page_desc(spark, data))
