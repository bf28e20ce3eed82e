"""The threat report as a nested, versioned JSON document, and back.

A report is a header (run, manifest, provenance, governance, summary) and its profiles.  Stored in a
folder, the header is one JSON line and the profiles are JSON lines of their own, so a report over
hourly windows is written and read by many tasks.  A report of few profiles can also be one
document with the profiles inside, which is the form other tools exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_VERSION = "1.0"
SINGLE_DOCUMENT_PROFILES = 10_000
_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "mode": "FAILFAST"}

# where the columns of a pipeline_runs row stand in the header
HEADER = {
    "report_name": "report_name", "pipeline_version": "pipeline_version", "run_id": "run_id", "timestamp": "run_timestamp",
    "execution_duration_seconds": "execution_duration_seconds", "dataset_path": "dataset_path",
    "source_manifest": {
        "source_manifest_hash": "source_manifest_hash", "files_count": "manifest_files_count", "total_bytes": "manifest_total_bytes"},
    "evidence_provenance": {
        "provenance_type": "provenance_type", "traffic_source": "traffic_source", "is_model_prediction": "is_model_prediction",
        "is_live_detection": "is_live_detection", "is_independently_verified": "is_independently_verified",
        "campaign_interval": {
            "window_type": "window_type", "window_start": "window_start", "window_end": "window_end",
            "interval_semantics": "interval_semantics"}},
    "model_governance": {
        "model_artifact": "model_artifact", "model_status": "model_status", "inference_executed": "model_inference_executed",
        "evaluation_metrics_status": "model_evaluation_metrics_status"},
    "summary": {
        "total_profiles_generated": "total_profiles", "attack_categories_count": "attack_categories_count",
        "benign_categories_count": "benign_categories_count", "unknown_categories_count": "unknown_categories_count",
        "target_impact_status": "target_impact_status"},
}
RUN_TYPES = {
    "run_timestamp": "timestamp", "execution_duration_seconds": "decimal(10,2)", "manifest_files_count": "int",
    "manifest_total_bytes": "bigint", "is_model_prediction": "boolean", "is_live_detection": "boolean",
    "is_independently_verified": "boolean", "window_start": "timestamp", "window_end": "timestamp",
    "model_inference_executed": "boolean", "total_profiles": "int", "attack_categories_count": "int",
    "benign_categories_count": "int", "unknown_categories_count": "int",
}
_SCORES = "struct<severity: double, frequency: double, recurrence: double, target_impact: double>"
PROFILE_SCHEMA = f"""profile_id string, snapshot_id string, run_id string, source_manifest_hash string, schema_version string,
window_type string, window_start string, window_end string,
category struct<canonical_label: string, raw_label: string, attack_status: string, is_attack: boolean, is_mapped: boolean>,
mitre_mapping struct<canonical_label: string, technique_id: string, technique_name: string, tactic: string, mapping_status: string,
 rationale: string, missing_telemetry: array<string>>,
flow_count bigint, total_bytes bigint, total_packets bigint, active_observation_units int, recurrence_denominator int,
model_reliability struct<class_name: string, validation_support: bigint, validation_precision: double, validation_recall: double,
 validation_f1: double, status: string, rationale: string>,
tlrs_result struct<components: {_SCORES}, weights: {_SCORES}, tlrs_complete: double, tlrs_complete_rounded: int,
 tlrs_partial_diagnostic: double, tlrs_normalized_heuristic: double, tlrs_normalized_rounded: int, evidence_coverage: double,
 scoring_status: string, risk_band: string, provisional_risk_band: string>,
advisories array<struct<recommendation_id: string, threat_category: string, priority: string, action_type: string, summary: string,
 detailed_guidance: string, missing_evidence_required: array<string>, analyst_validation_required: boolean>>"""


def _nested(tree: dict) -> list[Column]:
    return [(F.struct(*_nested(v)) if isinstance(v, dict) else F.col(v)).alias(k) for k, v in tree.items()]


def _types(tree: dict) -> str:
    """DDL of the fields of a header tree."""
    return ", ".join(f"{k}: " + (f"struct<{_types(v)}>" if isinstance(v, dict) else RUN_TYPES.get(v, "string")) for k, v in tree.items())


def _flat(tree: dict, path: str) -> list[Column]:
    out: list[Column] = []
    for k, v in tree.items():
        out += _flat(v, f"{path}.{k}") if isinstance(v, dict) else [F.col(f"{path}.{k}").alias(v)]
    return out


HEADER_SCHEMA = f"struct<document_version: string, {_types(HEADER)}>"
DOCUMENT_SCHEMA = f"{HEADER_SCHEMA[:-1]}, profiles: array<struct<{PROFILE_SCHEMA}>>>"


def header_lines(run: DataFrame) -> DataFrame:
    """value: the header of each pipeline_runs row as JSON."""
    return run.select(F.to_json(F.struct(F.lit(DOCUMENT_VERSION).alias("document_version"), *_nested(HEADER)), _FORMAT).alias("value"))


def profile_lines(profiles: DataFrame) -> DataFrame:
    """value: each profile as JSON."""
    return profiles.select(F.to_json(F.struct(*profiles.columns), _FORMAT).alias("value"))


def single_document(run: DataFrame, profiles: DataFrame, most: int = SINGLE_DOCUMENT_PROFILES) -> DataFrame:
    """value: one row with the header and, inside, the profiles by category and window; more than `most` are refused."""
    number = profiles.agg(F.count("*")).scalar()
    fits = F.assert_true(number <= most, F.lit(f"more than {most} profiles: store the report as a folder"))
    order = F.array_sort(F.collect_list(F.struct(F.col("category.canonical_label").alias("_label"), "window_start", "snapshot_id",
                                                 F.struct(*profiles.columns).alias("_profile"))))
    inside = profiles.agg(F.transform(order, lambda p: p["_profile"]).alias("profiles")).select("profiles").scalar()
    return run.where(fits.isNull()).select(F.to_json(F.struct(
        F.lit(DOCUMENT_VERSION).alias("document_version"), *_nested(HEADER), inside.alias("profiles")), _FORMAT).alias("value"))


def _known(version: Column) -> Column:
    """The version, or an error where this reader does not know it."""
    same = F.split_part(version, F.lit("."), F.lit(1)) == DOCUMENT_VERSION.split(".")[0]
    return F.when(same, version).otherwise(F.raise_error(F.concat(F.lit("unknown report version "), F.coalesce(version, F.lit("(none)")))))


def parsed_headers(lines: DataFrame) -> DataFrame:
    """pipeline_runs rows of JSON headers or single documents (column value)."""
    parsed = lines.select(F.from_json("value", HEADER_SCHEMA, _FORMAT).alias("d"))
    return parsed.where(_known(F.col("d.document_version")).isNotNull()).select(*_flat(HEADER, "d"))


def parsed_profiles(lines: DataFrame) -> DataFrame:
    """Profiles of JSON lines (column value)."""
    return lines.select(F.from_json("value", f"struct<{PROFILE_SCHEMA}>", _FORMAT).alias("p")).select("p.*")


def document_profiles(lines: DataFrame) -> DataFrame:
    """Profiles inside single documents (column value)."""
    parsed = lines.select(F.from_json("value", DOCUMENT_SCHEMA, _FORMAT).alias("d"))
    return parsed.where(_known(F.col("d.document_version")).isNotNull()).select(F.inline("d.profiles"))
