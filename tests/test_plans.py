"""Plan checks: no cross products, no Python in the expression paths, columns pruned at the scan."""

import re

import pytest

from ledgerscope.plans.catalog import load

SF = "/root/testdata/sf0.001"
CATALOG = load()
NAMES = [
    "p5_p6_tier1", "p11_context_adjustment", "j3_known_contact", "j4_payee_alerts", "j9_sanctions",
    "w1_sliding_velocity", "w3_burst_window", "w6_fingerprint_runs", "a1_velocity", "a4_window_flows",
    "a6_degrees", "a10_account_profile", "a14_set_features", "a15_benford", "a16_fan_in_zscore", "a22_graph_stats",
    "r0_rapid_relay", "r3_bipartite_core", "r4_cash_mule_sink", "r5_merchant_terminal", "m10_committee",
    "m13_thresholds_committee", "p21_account_opening", "p22_card_risk", "p23_bank_transactions",
    "n6_route_discovery", "n9_psi", "e1_route_feedback", "e9_erase",
]


def _plan(spark, name):
    return CATALOG[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_cross_product_or_python(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


def test_windows_share_one_shuffle_by_account(spark):
    plan = _plan(spark, "w1_sliding_velocity")
    assert plan.count("Exchange hashpartitioning(account_id") == 1


def test_scan_reads_only_used_columns(spark):
    plan = _plan(spark, "a15_benford_receipts")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_tax" not in schema and "l_shipdate" not in schema


def test_latest_rows_are_limited_before_the_shuffle(spark):
    assert _plan(spark, "w4_latest_n").count("WindowGroupLimit") >= 1


@pytest.mark.parametrize("name", ["u1_recently_active", "a1_velocity", "a2_account_means", "a13_burst_ratio"])
def test_time_filter_reaches_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts,", _plan(spark, name))
