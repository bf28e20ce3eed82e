"""Registered queries against their SQL counterpart at the smallest scale.

`python tests/check.py <sf>` runs all of them at any scale; here each module is sampled.
"""

import pytest

import __spark_entry__ as entry
from check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [
    "clean_flows", "clean_metrics_by_file", "category_normalization", "class_distribution", "temporal_profile",
    "traffic_stats", "port_matrix", "feature_correlations", "flow_aggregates_hourly", "advisories", "threat_profiles",
    "reliability_gate", "split_global", "split_per_class", "timestamp_ranks", "sampling_summary", "class_weights",
    "confusion_matrix", "model_diagnostics", "threshold_sweep", "policy_comparison", "tree_importance", "manifest_digest",
    "provenance_link", "table_hash", "table_manifest", "table_files", "audited_metrics", "audited_tokens", "integrity_from_cells",
    "evaluator_metrics_by_split", "one_vs_benign_auc", "event_value_auc", "threshold_study", "fit_rows_per_class", "report_profiles",
    "report_mappings", "report_tables", "cleaning_job", "threat_job",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 150


def test_entry(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == ""
