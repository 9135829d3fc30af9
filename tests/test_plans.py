"""Plan shape: partition pruning and column pruning reach the scans; no cross
joins, nested-loop joins or Python UDFs in the registered queries."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")
SAMPLE = ["m4_weekly_projection", "f8_point_in_time_features", "p19_context_assembly", "m9_route_model",
          "q8_weekly_board", "q13_position_rank", "w2_upsert_stats", "w5_upsert_context", "e1_attribution",
          "q17_projection_why", "s11_depth_rank", "p17_top_teammate_share"]


def _plan(spark, key):
    return entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_partitions_and_columns(spark):
    plan = _plan(spark, "m4_weekly_projection")
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "player_stats" in ln]
    assert scans, plan
    assert any("PartitionFilters: [isnotnull(season" in ln and "= 2001" in ln for ln in scans)
    assert all("carries" not in ln.split("Batched")[0] for ln in scans)   # unused column not read


@pytest.mark.parametrize("key", SAMPLE)
def test_no_cross_joins_or_python(spark, key):
    plan = _plan(spark, key)
    assert not [p for p in FORBIDDEN if p in plan]
