"""End-to-end jobs: cleaning, analytics report, training, threat intelligence."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.reliability import assess_reliability
from flowintel.functions.scoring import new_run_id
from flowintel.operators import (
    clean, distribution, evaluate, findings, importance, models, ports, profiles, redundancy, results, splits,
    thresholds, traffic,
)
from flowintel.operators.splits import TrainingConfig
from flowintel.session import checkpointed
from flowintel.sources import files, manifest, tables


def run_cleaning(
    spark: SparkSession, raw_dir: str, output: str, raw_files: list[str] | None = None, append: bool = False,
) -> dict[str, DataFrame]:
    """Raw CSV to curated Parquet plus the integrity report.

    With `append` the flows join those stored before, as captures arrive; the audit covers these raw files, class
    distribution and layout all that is stored.

    Two passes over the raw text: one aggregate per file with all counters, and the write.
    Counters are aggregated rather than observed during the write, because observed
    metrics can count a task twice when it is retried.
    """
    raw = files.read_raw_flows(spark, raw_dir, raw_files)
    audit = checkpointed(clean.cleaning_audit(raw))
    tables.write_curated(clean.clean_flows(raw), output, append=append)
    curated = files.read_curated(spark, output)
    return {
        "row_accounting": clean.audited_totals(audit),
        "repeated_headers_by_file": clean.audited_headers(audit),
        "token_profile": clean.audited_tokens(audit),
        "missing_files": spark.createDataFrame(
            [(name,) for name in files.selected_files(spark, raw_dir, raw_files or [])[1]], "file string"),
        "class_distribution": distribution.class_counts(curated),
        "storage_layout": files.storage_layout(spark, output),
    }


def analytics_sections(
    df: DataFrame, expected_rows: int | None = None, expected_dates: int | None = None, top_n: int = 5,
) -> dict[str, DataFrame]:
    """Sections of the analytics report, from three scans of `df`.

    The first counts the cells of (label, date, port), which are stored; five sections are sums over them.  Traffic
    statistics and correlations read their own columns.
    """
    cells, weight = checkpointed(distribution.flow_cells(df, dims.INTEGRITY_COLUMNS)), "flow_count"
    return {
        "data_integrity": clean.verify_integrity(df, expected_rows, expected_dates, cells=cells),
        "class_distribution": distribution.class_distribution(cells, weight=weight),
        "date_totals": distribution.date_totals(cells, weight=weight),
        "temporal_profiles": distribution.temporal_profile(cells, weight=weight),
        "traffic_characteristics": traffic.traffic_statistics(df),
        "destination_port_analysis": ports.port_concentration(cells, top_n, weight=weight),
        "feature_redundancy": redundancy.feature_correlations(df),
    }


def run_analytics(
    spark: SparkSession, curated: str, output: str, expected_rows: int | None = None,
    expected_dates: int | None = None,
) -> dict[str, DataFrame]:
    """Analytics report over curated flows, one JSON-lines folder per section.

    The observations are derived from the sections as written, not from the flows again.
    """
    sections = analytics_sections(files.read_curated(spark, curated), expected_rows, expected_dates)
    tables.write_json_sections(sections, output)
    report = {name: spark.read.json(f"{output}/{name}", schema=s.schema) for name, s in sections.items()}
    observed = findings.observations(
        report["temporal_profiles"], report["class_distribution"], report["destination_port_analysis"],
        report["feature_redundancy"], report["traffic_characteristics"])
    tables.write_json_sections({"observations": observed}, output)
    report["observations"] = spark.read.json(f"{output}/observations", schema=observed.schema)
    return report


def train_and_evaluate(df: DataFrame, config: TrainingConfig, model_dir: str | None = None) -> dict[str, object]:
    """Sample, split, fit, predict, evaluate; optionally store the model and its reports.

    Only the training rows are stored for the fit.  Held-out rows are scored in one scan that leaves counts of
    (split, label, prediction, adjusted prediction, threshold level); evaluation, confusion matrices and the threshold
    study derive from them.
    """
    prepared, features = models.prepare(df, config)
    rows = models.fit_rows(prepared, config)
    model = models.fit(prepared, features, config, rows)
    scored = models.predict(model, prepared.where(F.col("split").isin("val", "test")), config)
    counts = checkpointed(thresholds.level_counts(
        scored, thresholds.predicted_score(scored), by=["split", "adjusted_prediction"]))
    column = "adjusted_prediction" if config.apply_threshold_policy else "pred_idx"
    cells = evaluate.contingency(counts, "true_idx", column, ["split"], "n")
    metrics = evaluate.class_metrics(cells, ["split"])
    overall = evaluate.summary_metrics(metrics, ["split"])
    coverage = checkpointed(splits.split_coverage(prepared))
    matrices = evaluate.matrix_document(cells)
    if model_dir is not None:
        extra = {"evaluation_report": matrices, "class_weights": splits.class_weights(rows, config.max_class_weight)}
        if config.subsample_ratio is not None:
            by_class = checkpointed(splits.sampling_by_class(models.tag_training_sample(df, config), config.protect_rare_classes,
                                                             config.min_rare_class_samples))
            extra |= {"sampling_by_class": by_class, "sampling_summary": splits.sampling_summary(by_class, config.subsample_ratio)}
        models.save_model(model, features, config, coverage, overall, model_dir, extra)
        metrics.write.mode("overwrite").json(f"{model_dir}/class_metrics")
    plain = counts.groupBy("split", "_level", "true_idx", "pred_idx").agg(F.sum("n").alias("n"))
    return {
        "model": model, "features": features, "cells": cells, "class_metrics": metrics, "overall": overall,
        "coverage": coverage, "matrices": matrices, "thresholds": thresholds.threshold_study(plain),
        "importances": importance.rank_importances(models.forest_importances(model, features), 6),
    }


def reliability_table(metrics: DataFrame) -> DataFrame:
    """Reliability assessment per class from validation metrics (fixed class list); of several splits only validation counts."""
    if "split" in metrics.columns:
        metrics = metrics.where(F.col("split").isin("val", "validation"))
    judged = metrics.withColumn("_a", assess_reliability(
        F.col("class_name"), F.col("true_support"), F.col("precision"), F.col("recall"), F.col("f1_score")))
    return judged.select(
        "class_name", F.col("true_support").alias("validation_support"),
        F.col("precision").alias("validation_precision"), F.col("recall").alias("validation_recall"),
        F.col("f1_score").alias("validation_f1"), F.col("_a.status").alias("status"),
        F.col("_a.rationale").alias("rationale"))


def run_threat_intelligence(
    spark: SparkSession, curated: str, root: str, run_id: str | None = None, model_path: str | None = None,
    validation_metrics: DataFrame | None = None, taus: dict[int, float] | None = None,
    window_type: str = "full_campaign", if_exists: str = "replace", report_path: str | None = None,
) -> dict[str, DataFrame]:
    """Curated flows to stored threat profiles, and to a report document where `report_path` is given.

    Without `model_path` flows are grouped by their label.  With it they are grouped by
    the predicted label, optionally after the threshold policy.  The run's duration is the
    time until its profiles are built; loading them is not part of it.
    """
    began = time.monotonic()
    df = files.read_curated(spark, curated)
    if run_id is None:
        run_id = spark.range(1).select(new_run_id()).first()[0]
    source = checkpointed(manifest.manifest(manifest.file_entries(spark, curated)))
    manifest_hash = source.first()["source_manifest_hash"]
    label_col, source_type, reliability = "label", profiles.CURATED_SOURCE, None
    if model_path is not None:
        df = models.infer_labels(files.read_model(spark, model_path), df, taus)
        label_col, source_type = "inferred_label", profiles.MODEL_SOURCE
        reliability = None if validation_metrics is None else reliability_table(validation_metrics)
    aggregates = profiles.flow_aggregates(df, window_type, label_col)
    built = checkpointed(profiles.threat_profiles(aggregates, manifest_hash, run_id, source_type, reliability))
    run = results.run_row(
        built, source, run_id, F.current_timestamp(), curated, model_path is not None, model_path or "",
        round(time.monotonic() - began, 2), window_type=window_type)
    run = checkpointed(run)  # one timestamp for the tables and the document
    if report_path is not None:
        tables.write_report(report_path, run, built)
    stored = results.result_tables(built, run)
    tables.load_report(spark, root, built, stored, run_id, if_exists)
    return {"profiles": built, **{name: tables.read_table(spark, root, name) for name in results.RESULT_TABLES}}


def load_stored_report(spark: SparkSession, report_path: str, root: str, if_exists: str = "replace") -> str:
    """Result tables from a stored report document; returns stored, replaced or skipped."""
    run, built = tables.read_report(spark, report_path)
    run, built = checkpointed(run), checkpointed(built)
    found = run.select("run_id").take(2)
    if len(found) != 1 or not found[0]["run_id"]:
        raise tables.ReportPersistenceError("report needs one header with a run_id")
    return tables.load_report(spark, root, built, results.result_tables(built, run), found[0]["run_id"], if_exists)


def threshold_report(
    predictions: DataFrame, score_col: str | None = None, recall_target: float = thresholds.RECALL_TARGET,
) -> dict[str, DataFrame]:
    """Sweep and selection on validation rows, the selected rule beside the plain predictions on test rows.

    Without `score_col` the score is the probability of the predicted class.  One scan leaves the counts that all parts share.
    """
    score = thresholds.predicted_score(predictions) if score_col is None else F.col(score_col)
    return thresholds.threshold_study(thresholds.level_counts(predictions, score, by=["split"]), recall_target)


def analytical_tables(
    cells: DataFrame, concentration: DataFrame, model_artifact: str, dataset_path: str, report_timestamp: str,
    link: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Confusion and port rows stamped with the content hash of what they were built from.

    `link` is the one-row result of the provenance check; only a validated run is recorded.
    """
    dense = evaluate.dense_matrix(cells, ["split"])
    cell_hash = results.table_hash(dense).select("content_hash").scalar()
    port_hash = results.table_hash(
        concentration.select("class_name", "total_flows", F.explode("top_ports").alias("p")).select(
            "class_name", "total_flows", "p.*")).select("content_hash").scalar()
    run = None if link is None else link.select("linked_run_id").scalar()
    stamp = F.lit(report_timestamp)
    return (
        results.confusion_rows(dense, cell_hash, stamp, "flow-classifier", model_artifact, run),
        results.port_rows(concentration, port_hash, stamp, "flow-analytics", dataset_path, run),
    )


def report_tables(report: dict[str, DataFrame], expected_importances: int = 63) -> dict[str, DataFrame]:
    """Flat tables for display from report sections; a missing section is an error."""
    for name in ("date_totals", "temporal_profiles", "destination_port_analysis", "feature_redundancy"):
        if name not in report:
            raise ValueError(f"report has no section '{name}'")
    flat = {
        "dates": report["date_totals"].orderBy("event_date"),
        "temporal": report["temporal_profiles"].select(
            "class_name", "active_days_count", "primary_event_date", F.explode("daily_counts").alias("event_date", "flow_count")),
        "ports": report["destination_port_analysis"].select("class_name", "total_flows", F.inline("top_ports")),
        "pairs": report["feature_redundancy"].orderBy("pair_no"),
    }
    if "importances" in report:
        ranked = report["importances"]
        right_size = ranked.agg(F.count("*").alias("n")).select(
            F.assert_true(F.col("n") == expected_importances, F.lit("unexpected number of importances")).isNull()).scalar()
        flat["importances"] = ranked.where(right_size).orderBy("rank")
    return flat
