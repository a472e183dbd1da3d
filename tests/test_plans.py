"""Registered queries: cross-checks on the smallest data, and properties of their plans."""

import pytest

import __spark_entry__ as entry
from tests.crosscheck import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = (
    "scan_telemetry", "grid_missing", "history_complete", "future_labels", "pit_features", "dq_incidents",
    "merge_coverage", "covered_horizons", "latest_risk", "risk_summary", "even_sample", "ordinal_targets",
    "describe_by_service", "latency_percentiles", "stream_ingest",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    good, note = compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    assert good, note


def test_flagship_has_rows(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "error_rate__slope" in found.columns


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    "name",
    ("window_features", "future_labels", "pit_features", "average_precision", "operational_summary",
     "threshold_sweep", "delayed_labels", "phase_means", "run_starts"),
)
def test_plan_has_no_single_task_window_or_nested_loop(spark, name):
    frame = entry.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "SinglePartition", "BatchEvalPython"):
        assert word not in plan, word


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["window_features"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    (schema,) = {line.split("ReadSchema:")[1] for line in plan.splitlines() if "ReadSchema:" in line}
    assert "user_id" in schema and "event_type" in schema
