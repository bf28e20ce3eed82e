"""End-to-end jobs on small files, stored tables, models."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.operators import (
    clean, distribution, evaluate, importance, lookups, models, ports, profiles, results, splits)
from flowintel.operators.splits import TrainingConfig
from flowintel.plans import jobs
from flowintel.session import checkpointed
from flowintel.sources import files, manifest, tables
from flowintel.sources.tables import write_curated


@pytest.fixture(scope="module")
def curated(spark, flows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curated") / "flows.parquet")
    tables.write_curated(flows, path, rebalance=True)
    return path


@pytest.fixture(scope="module")
def trained(spark, flows, tmp_path_factory):
    model_dir = str(tmp_path_factory.mktemp("model"))
    config = TrainingConfig(split_strategy="chronological_per_class", num_trees=3, max_depth=4, apply_threshold_policy=True)
    result = jobs.train_and_evaluate(flows, config, model_dir)
    return result, config, model_dir


def test_cleaning_job_from_csv(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    header = ",".join(dims.RAW_COLUMNS)
    row = {c: "1" for c in dims.RAW_COLUMNS} | {"Label": "Bot", "Timestamp": "02/03/2018 08:00:00"}
    good = ",".join(row[c] for c in dims.RAW_COLUMNS)
    late = ",".join((row | {"Timestamp": "bad"})[c] for c in dims.RAW_COLUMNS)
    (raw / "a.csv").write_text("\n".join([header, good, header, late]) + "\n")
    (raw / "b.csv").write_text("\n".join([header, good, good]) + "\n")
    report = jobs.run_cleaning(spark, str(raw), str(tmp_path / "out"), ["a.csv", "b.csv", "missing.csv"])
    acc = report["row_accounting"].first()
    assert (acc.input_rows, acc.repeated_header_rows, acc.retained_rows, acc.invalid_timestamp_dropped) == (5, 1, 3, 1)
    assert [(r.file, r.repeated_headers_count) for r in report["repeated_headers_by_file"].collect()] == [("a.csv", 1)]
    assert [(r.label, r["count"]) for r in report["class_distribution"].collect()] == [("Bot", 3)]
    assert [r.file for r in report["missing_files"].collect()] == ["missing.csv"]
    layout = report["storage_layout"].collect()
    assert [r.event_date for r in layout] == ["2018-03-02"] and layout[0].total_bytes > 0
    tokens = {r.column_name: r for r in report["token_profile"].collect()}
    assert set(tokens) == set(dims.PROFILED_COLUMNS) and all(r.rows_profiled == 4 for r in tokens.values())
    with pytest.raises(FileNotFoundError):
        files.read_raw_flows(spark, str(raw), ["missing.csv"])
    with pytest.raises(FileNotFoundError):
        files.read_curated(spark, str(tmp_path / "nothing"))


def test_cleaning_reads_the_text_twice(spark, tmp_path, monkeypatch):
    """Once for all counters, once for the write; the counters equal those of the single audits."""
    raw_dir = tmp_path / "raw"
    raw_dir.mkdir()
    values = {c: ["1", "inf", "", "NaN", "-Infinity", "x"] for c in dims.RAW_COLUMNS}
    lines = [",".join(dims.RAW_COLUMNS)]
    for i in range(60):
        row = {c: v[(i + k) % 6] for k, (c, v) in enumerate(values.items())}
        row |= {"Label": ["Bot", "Label", "", "Benign"][i % 4], "Timestamp": ["02/03/2018 08:00:00", "no"][i % 5 == 0], "Flow Duration": str(i - 5)}
        lines.append(",".join(row[c] for c in dims.RAW_COLUMNS))
    (raw_dir / "a.csv").write_text("\n".join(lines[:40]) + "\n")
    (raw_dir / "b.csv").write_text("\n".join(lines[:1] + lines[40:]) + "\n")
    written = []
    monkeypatch.setattr(tables, "write_curated", lambda df, path, **k: written.append(plan_of(df)) or write_curated(df, path, **k))
    stored = []
    monkeypatch.setattr(jobs, "checkpointed", lambda df: stored.append(plan_of(df)) or checkpointed(df))
    report = jobs.run_cleaning(spark, str(raw_dir), str(tmp_path / "out"), ["a.csv", "b.csv"])
    assert [p.count("FileScan csv") for p in [*written, *stored]] == [1, 1]
    raw = files.read_raw_flows(spark, str(raw_dir), ["a.csv", "b.csv"])
    for got, want in ((report["row_accounting"], clean.cleaning_metrics(raw)),
                      (report["token_profile"], clean.profile_tokens(clean.without_repeated_headers(raw)).select(report["token_profile"].columns)),
                      (report["repeated_headers_by_file"], clean.audit_repeated_headers(raw))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_curated_round_trip(spark, flows, curated):
    back = files.read_curated(spark, curated)
    assert back.count() == flows.count()
    assert back.select("event_date").distinct().count() == 8
    plan = back.where(F.col("event_date") == "2018-02-15").select("label")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "ReadSchema: struct<label:string>" in plan


def test_manifest_matches_plain_python(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, content in (("b.bin", b"two"), ("d/a.bin", b"one"), ("_meta", b"x"), (".hidden", b"y")):
        (tmp_path / name).write_bytes(content)
    entries = [
        {"path": n, "sha256": hashlib.sha256(c).hexdigest(), "size_bytes": len(c)} for n, c in (("b.bin", b"two"), ("d/a.bin", b"one"))]
    found = manifest.file_entries(spark, str(tmp_path))
    hashes = [hashlib.sha256("".join(f"v{len(str(v))}:{v}" for v in (e["path"], e["sha256"], e["size_bytes"])).encode()).hexdigest()
              for e in entries]
    sums = ",".join(str(sum(int(h[8 * i : 8 * i + 8], 16) for h in hashes)) for i in range(8))
    m = manifest.manifest(found).first()
    want = hashlib.sha256(f"2,{sums}".encode()).hexdigest()[:16]
    assert (m.source_manifest_hash, m.files_count, m.total_bytes) == (want, 2, 6)
    assert manifest.manifest(found.orderBy(F.desc("path")).repartition(3)).first() == m
    incoming = spark.createDataFrame([("new.bin", entries[0]["sha256"], 3), ("x", "0" * 64, 1)], found.schema)
    assert [r.path for r in manifest.duplicate_files(incoming, found).collect()] == ["new.bin"]
    assert [r.path for r in manifest.novel_files(incoming, found).collect()] == ["x"]


def test_analytics_report(spark, curated, tmp_path):
    report = jobs.run_analytics(spark, curated, str(tmp_path / "r"), expected_dates=8)
    assert report["data_integrity"].first().passed_integrity_checks
    assert report["observations"].count() == 5
    flat = jobs.report_tables(report)
    assert flat["dates"].count() == 8 and flat["pairs"].count() == 9
    with pytest.raises(ValueError, match="temporal_profiles"):
        jobs.report_tables({"date_totals": report["date_totals"]})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_of(monkeypatch, module, build):
    """Result of a function and the file scans in the plans it stores and returns."""
    stored = []
    monkeypatch.setattr(module, "checkpointed", lambda df: stored.append(plan_of(df)) or checkpointed(df))
    result = build()
    return result, sum(plan.count("FileScan") for plan in [*stored, *map(plan_of, result.values())])


def test_analytics_reads_the_flows_three_times(spark, curated, monkeypatch):
    flows = files.read_curated(spark, curated)
    sections, scans = scans_of(monkeypatch, jobs, lambda: jobs.analytics_sections(flows, expected_dates=8))
    assert scans == 3
    plain = {
        "data_integrity": clean.verify_integrity(flows, None, 8), "class_distribution": distribution.class_distribution(flows),
        "date_totals": distribution.date_totals(flows), "temporal_profiles": distribution.temporal_profile(flows),
        "destination_port_analysis": ports.port_concentration(flows, 5)}
    for name, want in plain.items():
        assert sorted(map(str, sections[name].collect())) == sorted(map(str, want.collect())), name


def test_report_sections(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a": {"x": 1}, "b": None}))
    report = files.read_json_report(spark, [str(tmp_path / "no.json"), str(tmp_path / "r.json")], "a struct<x:int>, b struct<y:int>")
    assert files.report_section(report, "a").first().a.x == 1
    with pytest.raises(Exception, match="no section"):
        files.report_section(report, "b").collect()
    with pytest.raises(ValueError):
        files.report_section(report, "zzz")
    with pytest.raises(FileNotFoundError):
        files.read_json_report(spark, [str(tmp_path / "no.json")])


def test_threat_intelligence_job(spark, curated, tmp_path):
    root = str(tmp_path / "db")
    out = jobs.run_threat_intelligence(spark, curated, root, run_id="run_1")
    assert out["threat_profiles"].count() == 15 and out["mitre_mappings"].count() == 15
    unknown = out["threat_profiles"].where("canonical_label = 'UNKNOWN'").first()
    assert unknown.is_attack is None and unknown.attack_status == "UNKNOWN"
    assert out["advisories"].count() == 13 * 2 + 2
    run = out["pipeline_runs"].first()
    assert (run.total_profiles, run.attack_categories_count, run.benign_categories_count, run.unknown_categories_count) == (15, 13, 1, 1)
    assert not out["risk_assessments"].where("is_confirmed OR target_impact_score IS NOT NULL").count()
    first = {r.snapshot_id for r in out["threat_profiles"].collect()}

    again = jobs.run_threat_intelligence(spark, curated, root, run_id="run_1")
    assert {r.snapshot_id for r in again["threat_profiles"].collect()} == first
    jobs.run_threat_intelligence(spark, curated, root, run_id="run_2", window_type="daily")
    stored = tables.read_table(spark, root, "threat_profiles")
    assert stored.where("run_id = 'run_1'").count() == 15 and stored.where("run_id = 'run_2'").count() > 15
    one = tables.read_table(spark, root, "threat_profiles", "run_1")
    assert one.count() == 15 and "PartitionFilters: [isnotnull(run_id_part" in one._jdf.queryExecution().executedPlan().toString()
    assert tables.run_is_stored(spark, root, "run_2") and not tables.run_is_stored(spark, root, "run_3")
    with pytest.raises(tables.DuplicateRunError):
        jobs.run_threat_intelligence(spark, curated, root, run_id="run_1", if_exists="error")
    before = tables.read_table(spark, root, "advisories").count()
    jobs.run_threat_intelligence(spark, curated, root, run_id="run_1", window_type="daily", if_exists="skip")
    assert tables.read_table(spark, root, "advisories").count() == before

    all_tables = {n: tables.read_table(spark, root, n) for n in results.RESULT_TABLES}
    kept = results.surviving_tables(all_tables, "run_2")
    assert kept["threat_profiles"].count() == 15 and kept["advisories"].count() == 28
    assert results.orphans(all_tables["advisories"], all_tables["threat_profiles"], "snapshot_id").isEmpty()
    details = lookups.profile_details(
        all_tables["threat_profiles"], all_tables["risk_assessments"].drop("run_id"), all_tables["mitre_mappings"],
        all_tables["advisories"])
    assert details.count() == all_tables["threat_profiles"].count()
    assert lookups.missing_snapshots(spark.createDataFrame([("nope",)], "snapshot_id string"), all_tables["threat_profiles"]).count() == 1
    assert lookups.latest_run(all_tables["pipeline_runs"]).first().run_id == "run_2"


def test_failed_load_leaves_the_old_run(spark, curated, tmp_path):
    root = str(tmp_path / "db")
    good = jobs.run_threat_intelligence(spark, curated, root, run_id="r")
    broken = good["profiles"].withColumn("snapshot_id", F.when(F.col("category.canonical_label") == "Bot", "").otherwise(F.col("snapshot_id")))
    with pytest.raises(tables.ReportPersistenceError):
        tables.load_report(spark, root, broken, results.result_tables(broken, good["pipeline_runs"]), "r")
    with pytest.raises(tables.ReportPersistenceError):
        tables.load_report(spark, root, broken, {}, "")
    with pytest.raises(ValueError):
        tables.load_report(spark, root, broken, {}, "r", "merge")
    assert tables.read_table(spark, root, "threat_profiles").count() == 15


def test_paging_and_filters(spark, flows):
    table = results.profile_rows(profiles.threat_profiles(profiles.flow_aggregates(flows, "daily"), "m", "r"))
    pages = [lookups.page_profiles(table, 7, 7 * i).collect() for i in range(3)]
    ids = [r.snapshot_id for p in pages for r in p]
    assert len(set(ids)) == 21
    assert lookups.search_profiles(table, search=" dos ", attack_status="ALL").where("attack_status <> 'ATTACK'").isEmpty()
    assert lookups.search_profiles(table, is_attack=False).select("canonical_label").distinct().count() == 1
    assert lookups.valid_page_index(21, 7, 2) == 2 and lookups.valid_page_index(21, 7, 3) == 0
    with pytest.raises(ValueError):
        lookups.page_profiles(table, 101)
    tiers = lookups.with_reliability_tier(table, None).select("resolved_reliability_tier").distinct()
    assert {r[0] for r in tiers.collect()} == {"BASELINE", "UNAVAILABLE"}


def test_training_outputs(spark, trained):
    result, config, model_dir = trained
    overall = {r.split: r for r in result["overall"].collect()}
    assert set(overall) == {"val", "test"} and overall["test"].total_evaluated_samples > 0
    ranked = result["importances"].collect()
    assert [r.rank for r in ranked] == list(range(1, len(result["features"]) + 1))
    assert sum(r.importance for r in ranked) == pytest.approx(1.0, abs=1e-4)
    assert spark.read.json(f"{model_dir}/split_summary").count() == 14
    assert spark.read.json(f"{model_dir}/top_10_feature_importances").count() == 10
    weights = spark.read.json(f"{model_dir}/class_weights")
    assert weights.count() > 1 and weights.where("weight <= 0").isEmpty()
    stored = spark.read.json(f"{model_dir}/evaluation_report")
    cells = results.confusion_rows_from_matrix(stored, "test_metrics")
    assert cells.agg(F.sum("raw_count")).first()[0] == overall["test"].total_evaluated_samples


def test_thresholds_after_training(trained):
    """From a fitted model to the comparison: the rule is searched on validation rows and judged on test rows."""
    result, *_ = trained
    overall, study = {r.split: r.total_evaluated_samples for r in result["overall"].collect()}, result["thresholds"]
    sweep = study["sweep"].collect()
    assert len(sweep) == 81 and all(r.benign_total + r.attack_total == overall["val"] for r in sweep)
    selection = study["selection"].first()
    assert selection.total_candidates == 81
    assert study["classes"].agg(F.sum("support")).first()[0] == overall["test"]
    comparison = study["comparison"].first()
    if not selection.eligible_candidates_count:
        assert comparison.false_alarms_removed == 0
    assert comparison.policy_false_positives_alarms <= comparison.baseline_false_positives_alarms


def test_saved_model_and_tree_table(spark, flows, trained):
    result, config, model_dir = trained
    loaded = files.read_model(spark, f"{model_dir}/model")
    sample = splits.add_neutral_weight(flows.limit(50))
    a = loaded.transform(sample).select("prediction").collect()
    assert a == result["model"].transform(sample).select("prediction").collect()
    computed = importance.tree_importance(
        files.read_tree_nodes(spark, f"{model_dir}/model"), files.read_feature_order(spark, f"{model_dir}/model"))
    own = models.forest_importances(result["model"], result["features"])
    matches = importance.compare_importances(computed, own, 1e-6).collect()
    assert matches and all(r.matches for r in matches)
    assert importance.importance_checks(computed, len(result["features"])).first().passed
    with pytest.raises(FileNotFoundError):
        files.read_model(spark, f"{model_dir}/none")


def test_inference_job(spark, curated, trained, tmp_path):
    result, config, model_dir = trained
    out = jobs.run_threat_intelligence(
        spark, curated, str(tmp_path / "db"), run_id="m1", model_path=f"{model_dir}/model",
        validation_metrics=result["class_metrics"].where("split = 'val'"), taus=dims.TAU_BY_CLASS)
    run = out["pipeline_runs"].first()
    assert run.is_model_prediction and run.provenance_type == "model_inference"
    assert out["threat_profiles"].where("model_reliability IS NULL").isEmpty()
    assert out["threat_profiles"].agg(F.sum("flow_count")).first()[0] == files.read_curated(spark, curated).count()


def test_analytical_tables_replace_by_source(spark, flows, tmp_path):
    df = flows.select("label", "dst_port").withColumns({"label_idx": F.lit(0.0), "prediction": F.lit(0.0)})
    cells = evaluate.contingency(df.withColumn("split", F.lit("val")).unionByName(df.withColumn("split", F.lit("test"))), by=["split"])
    conf, port = jobs.analytical_tables(cells, ports.port_concentration(df), "m", "d", "2024-01-01T00:00:00")
    root = str(tmp_path / "a")
    for _ in range(2):
        tables.load_analytical(root, conf, port)
    stored = tables.read_analytical(spark, root, "analytical_confusion_matrix")
    assert stored.count() == 392 and stored.where("run_id IS NOT NULL").isEmpty()
    assert results.matrix_shape(stored).where("complete").count() == 2
    assert {r.violations for r in results.check_rules(stored, results.CONFUSION_RULES).collect()} == {0}
    assert {r.violations for r in results.check_rules(port, results.PORT_RULES).collect()} == {0}
    other = conf.withColumn("source_report_hash", F.lit("0" * 64))
    tables.load_analytical(root, other, port)
    assert tables.read_analytical(spark, root, "analytical_confusion_matrix").count() == 784
    keys, values = ["source_report_hash", "evaluated_split", "true_label_idx", "predicted_label_idx"], ["raw_count"]
    assert results.mismatches(stored, conf, keys, values).isEmpty()


def test_stored_matrix_is_flattened(spark):
    labels = dims.CLASS_LABELS
    raw = [[i * 14 + j for j in range(14)] for i in range(14)]
    doc = {"validation_metrics": {"confusion_matrix": {
        "class_labels": labels, "raw_matrix": raw, "normalized_matrix": [[0.5] * 14] * 14}}}
    schema = ("validation_metrics struct<confusion_matrix: struct<class_labels: array<string>, "
              "raw_matrix: array<array<bigint>>, normalized_matrix: array<array<double>>>>")
    report = spark.createDataFrame([(json.dumps(doc),)], "v string").select(
        F.from_json("v", schema).alias("r")).select("r.*")
    cells = results.confusion_rows_from_matrix(report, "validation_metrics")
    row = cells.where("true_idx = 2 AND pred_idx = 3").first()
    assert cells.count() == 196 and (row.raw_count, row.true_class_support) == (31, sum(raw[2]))
    assert (row.true_label, row.predicted_label) == (labels[2], labels[3])


def test_hash_is_order_independent(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS v")
    assert results.table_hash(df).first() == results.table_hash(df.orderBy(F.desc("id"))).first()
    assert results.table_hash(df).first() != results.table_hash(df.where("id <> 5")).first()
    doubled = results.table_hash(df.unionByName(df)).first()
    assert doubled.row_count == 200 and doubled.content_hash != "0"
    ordered = results.ordered_table_hash(df, "id").first()
    assert ordered == results.ordered_table_hash(df.orderBy(F.rand(1)).repartition(7), "id").first()


def test_hash_is_unambiguous(spark):
    def digest(*rows):
        return results.table_hash(spark.createDataFrame(rows, "a string, b string")).first().content_hash

    assert digest(("a|b", "c"), (None, "x")) != digest(("a", "b|c"), ("None", "x"))
    assert digest((None, "x")) != digest(("None", "x")) and digest(("", "x")) != digest((None, "x"))


def test_histogram_leaves_out_scores_beyond_its_range(spark):
    scores = [None, float("nan"), -0.5, 1.7, 1.0, 0.95, 0.0]
    df = spark.createDataFrame([(x, 0) for x in scores], "score double, label_idx int")
    bins = {r.bin: r.benign_count for r in evaluate.score_histogram(df, "score", "label_idx", {"benign": 0}).collect()}
    assert bins == {**dict.fromkeys(range(10), 0), 0: 1, 9: 2}
    assert tuple(evaluate.scores_outside(df, "score").first()) == (1, 1, 2)


def test_unlink_keeps_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int")
    assert {(r.run_id, r.n) for r in results.unlink_run(df, "a").collect()} == {(None, 1), ("b", 2)}
