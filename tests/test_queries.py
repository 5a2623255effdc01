"""One query per family against its SQL, and the shape of the registry."""
import pytest

import __spark_entry__ as entry
from tools.check import compare, connect
from tripwright.plans import load_registry

SF = "/root/testdata/sf0.001"
SAMPLE = ("s2_null_token_csv_scan", "p11_worst_tier_eligibility", "f3_local_hhmm_to_utc", "j1_asof_join_varied_delay",
          "j3_latest_report_lookup", "j6_partial_key_match", "j8_nearest_candidate_diff", "a13_roc_auc", "a15_ece",
          "w9_stratified_round_robin", "w11_subtract_intervals", "m4_oof_target_encode", "m15_threshold_optimism",
          "c8_plan_vs_result_completeness")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    status, _, note = compare(spark, connect(SF), load_registry()[name], SF)
    assert status == "ok", note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_comparison_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 179
