"""Guards the plan shapes: no cartesian products and no nested-loop joins in
representative registered queries (scripts/plan_audit.py checks them all)."""
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["symbolic_veto_by_source", "policy_decision", "confusion_grid_sweep", "best_grid_point",
         "union_fpr_budget", "ensemble_vs_single", "exact_cache_lookup", "quota_by_principal",
         "concurrency_peak", "dedup_first_wins"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_products(spark, name):
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
