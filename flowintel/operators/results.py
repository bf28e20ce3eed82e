"""Result tables: flattening of profiles, payload rules, integrity and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel.functions.digest import content_digest, row_text
from flowintel import dims
from flowintel.functions import scoring
from flowintel.functions.timeparse import normalized_path, parse_timestamp
from flowintel.operators.profiles import status_counts

RUN_KEY = "run_id"
CHILD_TABLES = ["threat_profiles", "mitre_mappings", "risk_assessments", "advisories"]
RESULT_TABLES = ["pipeline_runs", *CHILD_TABLES]


def profile_rows(profiles: DataFrame) -> DataFrame:
    """threat_profiles rows."""
    return profiles.select(
        "snapshot_id", "profile_id", RUN_KEY, "source_manifest_hash", "schema_version", "window_type",
        parse_timestamp(F.col("window_start")).alias("window_start"),
        parse_timestamp(F.col("window_end")).alias("window_end"),
        F.coalesce("category.canonical_label", F.lit("Unknown")).alias("canonical_label"),
        F.coalesce("category.raw_label", "category.canonical_label").alias("raw_label"),
        F.coalesce("category.attack_status", F.lit(dims.UNKNOWN)).alias("attack_status"),
        F.col("category.is_attack").alias("is_attack"),
        F.coalesce("category.is_mapped", F.lit(True)).alias("is_mapped"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("flow_count", "total_bytes", "total_packets")],
        F.coalesce("active_observation_units", F.lit(0)).cast("int").alias("active_observation_units"),
        F.coalesce("recurrence_denominator", F.lit(8)).cast("int").alias("recurrence_denominator"),
        scoring.recurrence_ratio(
            F.coalesce("active_observation_units", F.lit(0)), F.coalesce("recurrence_denominator", F.lit(8))
        ).cast("decimal(6,4)").alias("recurrence_ratio"),
        F.col("model_reliability.status").alias("model_reliability"),
    )


def mapping_rows(profiles: DataFrame) -> DataFrame:
    """mitre_mappings rows; only a verified mapping is confirmed."""
    m = "mitre_mapping"
    status = F.coalesce(f"{m}.mapping_status", F.lit("unverified"))
    return profiles.select(
        "snapshot_id", RUN_KEY,
        F.coalesce(f"{m}.canonical_label", "category.canonical_label").alias("canonical_label"),
        F.col(f"{m}.technique_id"), F.col(f"{m}.technique_name"), F.col(f"{m}.tactic"),
        status.alias("mapping_status"),
        scoring.mapping_confirmed(status).alias("is_confirmed"),
        F.col(f"{m}.rationale"),
        F.coalesce(f"{m}.missing_telemetry", F.array().cast("array<string>")).alias("missing_telemetry"),
    )


def risk_rows(profiles: DataFrame) -> DataFrame:
    """risk_assessments rows; a missing target impact stays null."""
    t = "tlrs_result"

    def number(path: str, default: float | None, kind: str) -> Column:
        value = F.col(f"{t}.{path}")
        return (value if default is None else F.coalesce(value, F.lit(default))).cast(kind)

    status = F.coalesce(f"{t}.scoring_status", F.lit("insufficient_evidence"))
    score, weight = "decimal(6,2)", "decimal(4,2)"
    return profiles.select(
        "snapshot_id", RUN_KEY,
        number("components.severity", 0.0, score).alias("severity_score"),
        number("components.frequency", 0.0, score).alias("frequency_score"),
        number("components.recurrence", 0.0, score).alias("recurrence_score"),
        number("components.target_impact", None, score).alias("target_impact_score"),
        number("weights.severity", dims.WEIGHT_SEVERITY, weight).alias("weight_severity"),
        number("weights.frequency", dims.WEIGHT_FREQUENCY, weight).alias("weight_frequency"),
        number("weights.recurrence", dims.WEIGHT_RECURRENCE, weight).alias("weight_recurrence"),
        number("weights.target_impact", dims.WEIGHT_TARGET_IMPACT, weight).alias("weight_target_impact"),
        number("tlrs_complete", None, score).alias("tlrs_complete"),
        number("tlrs_complete_rounded", None, "int").alias("tlrs_complete_rounded"),
        number("tlrs_partial_diagnostic", 0.0, score).alias("tlrs_partial_diagnostic"),
        number("tlrs_normalized_heuristic", 0.0, score).alias("tlrs_normalized_heuristic"),
        number("tlrs_normalized_rounded", 0, "int").alias("tlrs_normalized_rounded"),
        number("evidence_coverage", 0.85, weight).alias("evidence_coverage"),
        status.alias("scoring_status"),
        F.coalesce(f"{t}.risk_band", F.lit("Insufficient Evidence")).alias("risk_band"),
        F.col(f"{t}.provisional_risk_band"),
        scoring.risk_confirmed(status, F.col(f"{t}.tlrs_complete")).alias("is_confirmed"),
    )


def advisory_rows(profiles: DataFrame) -> DataFrame:
    """advisories rows with their position in the profile; never an automated action."""
    listed = profiles.select(
        "snapshot_id", RUN_KEY, F.col("category.canonical_label").alias("_label"),
        F.posexplode("advisories").alias("position", "a"))
    return listed.select(
        "snapshot_id", RUN_KEY, "position", F.col("a.recommendation_id"),
        F.coalesce("a.threat_category", "_label").alias("threat_category"),
        F.coalesce("a.priority", F.lit("Medium")).alias("priority"),
        F.coalesce("a.action_type", F.lit("Investigation")).alias("action_type"),
        F.coalesce("a.summary", F.lit("")).alias("summary"),
        F.coalesce("a.detailed_guidance", F.lit("")).alias("detailed_guidance"),
        F.coalesce("a.missing_evidence_required", F.array().cast("array<string>")).alias("missing_evidence_required"),
        F.coalesce("a.analyst_validation_required", F.lit(True)).alias("analyst_validation_required"),
        F.lit(False).alias("is_automated_action"),
    )


def run_row(
    profiles: DataFrame, manifest: DataFrame, run_id: str, run_timestamp: Column, dataset_path: str,
    inference: bool = False, model_artifact: str = "", duration_seconds: float = 0.0,
    campaign: tuple[str, str] = (dims.CAMPAIGN_START, dims.CAMPAIGN_END), window_type: str = "full_campaign",
) -> DataFrame:
    """pipeline_runs row: provenance, governance and summary counts of one run.

    A run over daily or hourly windows spans from the first window's start to the last one's
    end; without any dated window, and for the full campaign, the campaign's bounds stand.
    """
    source = manifest.select(F.struct("source_manifest_hash", "files_count", "total_bytes")).scalar()
    start, end = (F.lit(x).cast("timestamp") for x in campaign)
    if window_type != "full_campaign":
        spanned = profiles.agg(F.struct(
            F.min("window_start").cast("timestamp").alias("start"), F.max("window_end").cast("timestamp").alias("end"))).scalar()
        start, end = F.coalesce(spanned["start"], start), F.coalesce(spanned["end"], end)
    return status_counts(profiles).select(
        F.lit(run_id).alias(RUN_KEY),
        F.lit("flow-threat-intelligence").alias("report_name"),
        F.lit("1.0.0").alias("pipeline_version"),
        run_timestamp.alias("run_timestamp"),
        F.lit(duration_seconds).cast("decimal(10,2)").alias("execution_duration_seconds"),
        F.lit(dataset_path).alias("dataset_path"),
        source["source_manifest_hash"].alias("source_manifest_hash"),
        source["files_count"].cast("int").alias("manifest_files_count"),
        source["total_bytes"].alias("manifest_total_bytes"),
        F.lit("model_inference" if inference else "curated_dataset_flows").alias("provenance_type"),
        F.lit("CSE-CIC-IDS2018 enterprise emulation lab traffic").alias("traffic_source"),
        F.lit(inference).alias("is_model_prediction"),
        F.lit(False).alias("is_live_detection"),
        F.lit(False).alias("is_independently_verified"),
        F.lit(window_type).alias("window_type"),
        start.alias("window_start"),
        end.alias("window_end"),
        F.lit("[window_start, window_end) half-open").alias("interval_semantics"),
        F.lit(model_artifact).alias("model_artifact"),
        F.lit("OPERATIONAL_EVALUATED" if inference else "INFERENCE_DISABLED").alias("model_status"),
        F.lit(inference).alias("model_inference_executed"),
        F.lit("EVALUATED_VALIDATION_METRICS" if inference else "EXCLUDED_FROM_EVIDENCE")
        .alias("model_evaluation_metrics_status"),
        F.col("total_profiles_generated").cast("int").alias("total_profiles"),
        *[F.col(c).cast("int").alias(c) for c in (
            "attack_categories_count", "benign_categories_count", "unknown_categories_count")],
        F.lit("MISSING_EVIDENCE_WITHHELD").alias("target_impact_status"),
    )


def result_tables(profiles: DataFrame, run: DataFrame) -> dict[str, DataFrame]:
    return {
        "pipeline_runs": run,
        "threat_profiles": profile_rows(profiles),
        "mitre_mappings": mapping_rows(profiles),
        "risk_assessments": risk_rows(profiles),
        "advisories": advisory_rows(profiles),
    }


def invalid_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles without a non-empty run, snapshot or profile key."""
    keys = [RUN_KEY, "snapshot_id", "profile_id"]
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.coalesce(F.col(k) == "", F.lit(True))
    return profiles.where(bad)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent key does not exist."""
    return child.join(parent.select(key), key, "left_anti")


def surviving_tables(tables: dict[str, DataFrame], removed_run: str) -> dict[str, DataFrame]:
    """All result tables after a run is deleted together with its children."""
    runs = tables["pipeline_runs"].where(F.col(RUN_KEY) != removed_run)
    profiles = tables["threat_profiles"].join(runs.select(RUN_KEY), RUN_KEY, "left_semi")
    kept = {"pipeline_runs": runs, "threat_profiles": profiles}
    for name in CHILD_TABLES[1:]:
        kept[name] = tables[name].join(profiles.select("snapshot_id"), "snapshot_id", "left_semi")
    return kept


def unlink_run(analytical: DataFrame, removed_run: str) -> DataFrame:
    """Analytical rows outlive their run; only the reference to it is cleared."""
    return analytical.withColumn(RUN_KEY, F.when(F.col(RUN_KEY) != removed_run, F.col(RUN_KEY)))


def confusion_rows(
    cells: DataFrame, source_hash: Column, report_timestamp: Column, pipeline_name: str, model_artifact: str,
    run_id: Column | None = None,
) -> DataFrame:
    """analytical_confusion_matrix rows from dense cells with a `split` column."""
    split = F.when(F.col("split") == "val", "validation").otherwise(F.col("split"))
    return cells.select(
        source_hash.alias("source_report_hash"), report_timestamp.alias("report_timestamp"),
        F.lit(pipeline_name).alias("pipeline_name"), F.lit(model_artifact).alias("model_artifact"),
        (F.lit(None).cast("string") if run_id is None else run_id).alias(RUN_KEY),
        split.alias("evaluated_split"), "true_label", "predicted_label",
        F.col("true_idx").alias("true_label_idx"), F.col("pred_idx").alias("predicted_label_idx"),
        F.col("raw_count"), F.col("true_class_support"),
        F.col("normalized_ratio").cast("decimal(8,4)").alias("normalized_ratio"))


def confusion_rows_from_matrix(report: DataFrame, split_key: str) -> DataFrame:
    """Cells of a stored matrix: struct(class_labels, raw_matrix, normalized_matrix) in a report column."""
    m = f"{split_key}.confusion_matrix"
    by_row = report.select(
        F.col(f"{m}.class_labels").alias("labels"), F.col(f"{m}.normalized_matrix").alias("norm"),
        F.posexplode(f"{m}.raw_matrix").alias("true_idx", "raw_row"))
    by_cell = by_row.select(
        "labels", "norm", "true_idx", F.aggregate("raw_row", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("support"),
        F.posexplode("raw_row").alias("pred_idx", "raw_count"))
    return by_cell.select(
        F.lit("val" if split_key.startswith("val") else "test").alias("split"), "true_idx", "pred_idx",
        F.get("labels", "true_idx").alias("true_label"), F.get("labels", "pred_idx").alias("predicted_label"),
        F.col("raw_count").cast("bigint").alias("raw_count"), F.col("support").alias("true_class_support"),
        F.get(F.get("norm", "true_idx"), "pred_idx").cast("double").alias("normalized_ratio"))


def port_rows(
    concentration: DataFrame, source_hash: Column, report_timestamp: Column, report_name: str, dataset_path: str,
    run_id: Column | None = None,
) -> DataFrame:
    """analytical_port_concentration rows, one per (category, port)."""
    listed = concentration.select(
        "class_name", "total_flows", "has_extreme_port_concentration", F.explode("top_ports").alias("p"))
    return listed.select(
        source_hash.alias("source_report_hash"), report_timestamp.alias("report_timestamp"),
        F.lit(report_name).alias("report_name"), F.lit(dataset_path).alias("dataset_path"),
        (F.lit(None).cast("string") if run_id is None else run_id).alias(RUN_KEY),
        F.col("class_name").alias("threat_category"), F.col("p.port").alias("destination_port"),
        F.col("p.service_name"), F.col("p.criticality_weight"), F.col("p.flow_count"),
        F.col("total_flows").alias("total_class_flows"),
        F.col("p.percentage_within_class").cast("decimal(6,2)").alias("percentage_within_class"),
        F.col("has_extreme_port_concentration").alias("has_extreme_concentration"))


CONFUSION_RULES = {
    "count_missing_or_negative": "raw_count IS NULL OR raw_count < 0",
    "index_outside_classes": f"NOT coalesce(true_label_idx BETWEEN 0 AND {dims.NUM_CLASSES - 1} AND "
                             f"predicted_label_idx BETWEEN 0 AND {dims.NUM_CLASSES - 1}, false)",
    "label_missing": "true_label IS NULL OR predicted_label IS NULL",
    "support_missing_or_negative": "true_class_support IS NULL OR true_class_support < 0",
    "ratio_missing": "normalized_ratio IS NULL",
}
PORT_RULES = {
    "total_missing_or_zero": "total_class_flows IS NULL OR total_class_flows <= 0",
    "port_outside_range": "NOT coalesce(destination_port BETWEEN 0 AND 65535, false)",
    "percentage_outside_range": "NOT coalesce(percentage_within_class BETWEEN 0 AND 100, false)",
    "count_missing_or_negative": "flow_count IS NULL OR flow_count < 0",
}


def check_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, violations: every rule counted in one pass."""
    counters = [
        F.struct(F.lit(name).alias("rule"), F.count_if(F.expr(text)).alias("violations"))
        for name, text in rules.items()]
    return df.agg(F.array(*counters).alias("r")).select(F.inline("r"))


def matrix_shape(cells: DataFrame) -> DataFrame:
    """Cells per split against the expected square."""
    expected = dims.NUM_CLASSES ** 2
    return cells.groupBy("evaluated_split").agg(
        F.count("*").alias("cells"), F.count_distinct("true_label_idx").alias("true_classes"),
        F.count_distinct("predicted_label_idx").alias("predicted_classes"),
    ).withColumn("complete", (F.col("cells") == expected) & (F.col("true_classes") == dims.NUM_CLASSES)
                 & (F.col("predicted_classes") == dims.NUM_CLASSES))


def mismatches(stored: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that are missing on one side or whose values differ."""
    left = stored.select(*keys, F.struct(*values).alias("stored"))
    right = source.select(*keys, F.struct(*values).alias("source"))
    state = (
        F.when(F.col("stored").isNull(), "missing_in_store")
        .when(F.col("source").isNull(), "missing_in_source")
        .when(~F.col("stored").eqNullSafe(F.col("source")), "different")
    )
    return left.join(right, keys, "full_outer").withColumn("problem", state).where(F.col("problem").isNotNull()).select(
        *keys, "problem")


def verification_summary(stored: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts of stored rows, source rows and mismatches."""
    problems = mismatches(stored, source, keys, values)
    counts = [
        stored.agg(F.lit("stored_rows").alias("measure"), F.count("*").alias("n")),
        source.agg(F.lit("source_rows").alias("measure"), F.count("*").alias("n")),
        problems.agg(F.lit("mismatches").alias("measure"), F.count("*").alias("n")),
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def table_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and order-independent content hash over all 256 bits of the row hashes.

    Rows are hashed on their own and the hashes are summed, so nothing is sorted or
    gathered; equal rows add up instead of cancelling out.
    """
    return df.agg(
        F.count("*").alias("row_count"),
        content_digest(F.sha2(row_text(columns or df.columns), 256)).alias("content_hash"))


def ordered_table_hash(df: DataFrame, order_col: str, columns: list[str] | None = None) -> DataFrame:
    """Content hash of a table whose rows are ordered by a key: the key is part of every row, so its order is."""
    columns = columns or df.columns
    return table_hash(df, [order_col, *[c for c in columns if c != order_col]])


def provenance_link(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Per (run, report): whether model and dataset paths agree after normalization.

    `reports` has run_id, model_location, dataset_path.  Both must match to link a run.
    """
    r = reports.select(
        RUN_KEY, F.col("model_location").alias("report_model"), F.col("dataset_path").alias("report_dataset"))
    joined = r.join(runs.select(RUN_KEY, "model_artifact", "dataset_path"), RUN_KEY, "left")

    def same(a: str, b: str) -> Column:
        equal = normalized_path(F.col(a)) == normalized_path(F.col(b))
        return F.coalesce(equal & (F.col(b) != ""), F.lit(False))

    checked = joined.select(
        RUN_KEY, F.col("model_artifact").isNotNull().alias("run_found"),
        same("model_artifact", "report_model").alias("model_matches"),
        same("dataset_path", "report_dataset").alias("dataset_matches"))
    linked = F.col("run_found") & F.col("model_matches") & F.col("dataset_matches")
    return checked.withColumn("linked_run_id", F.when(linked, F.col(RUN_KEY)))
