"""Plans have the shape that holds at scale: filters and columns reach the scan, rankings
are cut before the shuffle, range joins are equi-joins, native operators run no Python."""

import pytest

from tessera import plans

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "name, held, absent",
    [
        ("q_pricing_summary", ["PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate", "partial_sum"], ["l_comment", "l_partkey"]),
        ("scan_point", ["In(c_custkey"], []),
        ("top_k", ["TakeOrderedAndProject"], ["Exchange rangepartitioning"]),
        ("window_top_per_group", ["WindowGroupLimit"], []),
        ("project_distinct_on", ["WindowGroupLimit"], []),
        ("join_range_bands", [], ["BroadcastNestedLoopJoin", "CartesianProduct"]),
        ("where_exists", ["LeftSemi"], []),
        ("vector_top_l2", ["TakeOrderedAndProject"], ["Python"]),
        ("fts_match", ["PushedFilters"], ["Python", "CartesianProduct"]),
    ],
)
def test_shape(spark, name, held, absent):
    text = plan(plans.queries()[name](spark, SF))
    for part in held:
        assert part in text, text
    for part in absent:
        assert part not in text, text


def test_only_wanted_columns_are_read(spark):
    text = plan(plans.queries()["group_alias"](spark, SF))
    assert "ReadSchema: struct<c_mktsegment:string>" in text


def test_no_cartesian_products(spark):
    """But for the one query that asks for a cross join of two small tables."""
    for name in plans.queries():
        if name.startswith(("join_", "where_", "window_", "set_")) and name != "join_cross":
            assert "CartesianProduct" not in plan(plans.queries()[name](spark, SF)), name
