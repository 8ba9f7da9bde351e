"""What the plans of the registered queries must and must not contain."""

import pytest

import __spark_entry__ as registry

from fleetpulse.plans.registry import entries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: registry.queries()[name] for name in entries()}
PYTHON_SENDER = set()  # the sender ran before its stored attempts are read


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_rollup", "stream_alerts"}))
def test_no_cross_joins_and_no_python_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    python = any(op in plan for op in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"))
    assert python == (name in PYTHON_SENDER)


def test_closed_hour_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["hourly_rollup"](spark, SF_DIR))
    assert "LessThan(ts,2024-01-31T00:00)" in plan
    assert "event_type" not in plan.split("ReadSchema:")[1]


def test_latest_reads_json_only_for_the_rows_found(spark):
    scans = [s.split("\n")[0] for s in plan_of(QUERIES["telemetry_latest"](spark, SF_DIR)).split("ReadSchema: ")[1:]]
    assert sorted("props" in s for s in scans) == [False, True]


def test_newest_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["analytics_points"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["telemetry_latest", "telemetry_history"])
def test_no_json_goes_through_a_shuffle_below_the_join(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = plan.index("BroadcastHashJoin")
    assert "SortMergeJoin" not in plan
    exchanges = [line for line in plan[join:].split("\n") if "Exchange" in line]
    assert all("BroadcastExchange" in line for line in exchanges)
