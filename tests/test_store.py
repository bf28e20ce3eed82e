"""Report documents and the retention of loads."""

import json
import time

import pytest
from pyspark.sql import functions as F

from flowintel.operators import report, results
from flowintel.plans import jobs
from flowintel.sources import retention, tables


@pytest.fixture(scope="module")
def curated(spark, flows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("curated") / "flows.parquet")
    tables.write_curated(flows.where("label IN ('Bot', 'Benign', 'DoS-Hulk')"), path)
    return path


def rows(frame):
    return sorted(map(str, frame.collect()))


def stored_tables(spark, root):
    return {name: tables.read_table(spark, root, name) for name in results.RESULT_TABLES}


@pytest.mark.parametrize("window", ["full_campaign", "daily"])
def test_report_round_trip(spark, curated, tmp_path, window):
    """Written, read back, loaded: all five tables equal those of the run itself."""
    made = jobs.run_threat_intelligence(spark, curated, str(tmp_path / "a"), "run/1 %", window_type=window, report_path=str(tmp_path / "report"))
    run, built = tables.read_report(spark, str(tmp_path / "report"))
    assert built.count() == made["profiles"].count() and set(run.columns) == set(made["pipeline_runs"].columns)
    assert jobs.load_stored_report(spark, str(tmp_path / "report"), str(tmp_path / "b")) == "stored"
    again = stored_tables(spark, str(tmp_path / "b"))
    for name in results.RESULT_TABLES:
        assert again[name].count() and rows(again[name].select(made[name].columns)) == rows(made[name]), name
    assert jobs.load_stored_report(spark, str(tmp_path / "report"), str(tmp_path / "b"), "skip") == "skipped"

    tables.write_single_report(str(tmp_path / "one"), made["pipeline_runs"], made["profiles"])
    document = json.loads(next((tmp_path / "one").glob("part-*")).read_text())
    assert document["document_version"] == "1.0" and document["run_id"] == "run/1 %"
    assert document["summary"]["total_profiles_generated"] == len(document["profiles"])
    assert document["summary"]["attack_categories_count"] + document["summary"]["benign_categories_count"] == len(document["profiles"])
    assert not document["model_governance"]["inference_executed"]
    run, built = tables.read_report(spark, str(tmp_path / "one"))
    want = report.parsed_profiles(report.profile_lines(made["profiles"]))
    assert rows(built) == rows(want) and rows(run) == rows(report.parsed_headers(report.header_lines(made["pipeline_runs"])))


def test_bad_documents(spark, curated, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, str(tmp_path / "none"))
    made = jobs.run_threat_intelligence(spark, curated, str(tmp_path / "a"), "r")
    with pytest.raises(Exception, match="more than 1 profiles"):
        report.single_document(made["pipeline_runs"], made["profiles"], most=1).collect()
    future = report.header_lines(made["pipeline_runs"]).select(F.replace("value", F.lit('"1.0"'), F.lit('"2.0"')).alias("value"))
    with pytest.raises(Exception, match="unknown report version 2.0"):
        report.parsed_headers(future).collect()
    (tmp_path / "empty.json").write_text(json.dumps({"document_version": "1.0", "profiles": []}))
    with pytest.raises(tables.ReportPersistenceError):
        jobs.load_stored_report(spark, str(tmp_path / "empty.json"), str(tmp_path / "b"))
    (tmp_path / "broken.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        jobs.load_stored_report(spark, str(tmp_path / "broken.json"), str(tmp_path / "b"))


def load_ids(root, table):
    return {p.name.split("key-")[1] for p in (root / table).glob("run_id_part=*/load_id_part=*")}


def test_superseded_loads_go_after_their_age(spark, curated, tmp_path):
    root = tmp_path / "db"
    made = jobs.run_threat_intelligence(spark, curated, str(root), "run a%2")
    first = load_ids(root, "advisories")
    assert retention.superseded_loads(spark, str(root)).isEmpty()
    tables.load_report(spark, str(root), made["profiles"], results.result_tables(made["profiles"], made["pipeline_runs"]), "run a%2")
    current = load_ids(root, "advisories") - first
    unused = retention.superseded_loads(spark, str(root))
    assert {(r.table_name, r.load_id) for r in unused.collect()} == {(t, i) for t in results.CHILD_TABLES for i in first}
    # unused only since the replacement, so a set age still protects readers of the old load
    assert retention.remove_superseded(spark, str(root), min_age_hours=1).isEmpty() and load_ids(root, "advisories") == first | current
    assert retention.remove_superseded(spark, str(root), 0, dry_run=True).count() == 4 and load_ids(root, "advisories") == first | current
    before = {n: rows(t) for n, t in stored_tables(spark, str(root)).items()}
    removed = retention.remove_superseded(spark, str(root), 0)
    assert removed.count() == 4 and removed.where("files > 0 AND bytes > 0").count() == 4
    assert all(load_ids(root, t) == current for t in results.CHILD_TABLES)
    assert {n: rows(t) for n, t in stored_tables(spark, str(root)).items()} == before
    assert retention.remove_superseded(spark, str(root), 0).isEmpty()


def test_failed_and_running_loads(spark, curated, tmp_path, monkeypatch):
    """A failed load's folders go; those of a load that still writes stay, also when retention runs in between."""
    root = tmp_path / "db"
    made = jobs.run_threat_intelligence(spark, curated, str(root), "r")
    current = load_ids(root, "threat_profiles")
    content = results.result_tables(made["profiles"], made["pipeline_runs"])
    write, seen = tables._write, []

    def failing(df, path, keys):
        if path.endswith("risk_assessments"):
            raise OSError("disk full")
        write(df, path, keys)

    monkeypatch.setattr(tables, "_write", failing)
    with pytest.raises(OSError):
        tables.load_report(spark, str(root), made["profiles"], content, "r")
    failed = load_ids(root, "threat_profiles") - current
    assert len(failed) == 1 and not list((root / tables.LOADING).glob("[!.]*"))

    def watched(df, path, keys):
        write(df, path, keys)
        if path.endswith("risk_assessments"):
            seen.append(load_ids(root, "threat_profiles") - current - failed)
            retention.remove_superseded(spark, str(root), 0)

    monkeypatch.setattr(tables, "_write", watched)
    assert tables.load_report(spark, str(root), made["profiles"], content, "r") == "replaced"
    (running,) = seen
    assert len(running) == 1 and load_ids(root, "threat_profiles") == current | running - failed
    monkeypatch.setattr(tables, "_write", write)
    assert tables.read_table(spark, str(root), "threat_profiles").count() == made["profiles"].count()
    assert load_ids(root, "threat_profiles") == current | running


def test_marks_of_dead_loads_expire(spark, tmp_path):
    root = tmp_path / "db"
    (root / tables.LOADING).mkdir(parents=True)
    (root / tables.LOADING / "dead").write_text("")
    assert tables.loads_in_progress(spark, str(root), 1) == ["dead"]
    time.sleep(0.01)
    assert tables.loads_in_progress(spark, str(root), 0) == []
    assert retention.superseded_loads(spark, str(root)).isEmpty()
