import hashlib

import pytest
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions import advisories as adv
from flowintel.functions import display, reliability, scoring, timeparse
from flowintel.functions.labels import index_to_label, normalize_category


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,expected", [(19.5, 20), (0.49, 0), (2.5, 3), (-2.5, -2), (67.6471, 68)])
def test_round_half_up(spark, value, expected):
    assert one(spark, scoring.round_half_up(F.lit(value))) == expected


@pytest.mark.parametrize("score,band", [
    (0, "Informational"), (19, "Informational"), (20, "Low"), (39, "Low"), (40, "Medium"), (60, "High"), (79, "High"),
    (80, "Critical"), (100, "Critical")])
def test_bands(spark, score, band):
    assert one(spark, scoring.risk_band(F.lit(score))) == band


@pytest.mark.parametrize("n,score", [(0, 0.0), (-3, 0.0), (1, 0.0), (1000, 50.0), (10**6, 100.0), (10**8, 100.0)])
def test_frequency(spark, n, score):
    assert one(spark, scoring.frequency_score(F.lit(n))) == pytest.approx(score)


@pytest.mark.parametrize("units,window,score", [
    (0, "daily", 0.0), (1, "full_campaign", 12.5), (12, "daily", 50.0), (6, "hourly", 50.0), (9, "full_campaign", 100.0),
    (2, "other", 25.0)])
def test_recurrence(spark, units, window, score):
    column = scoring.recurrence_score(F.lit(units), scoring.recurrence_denominator(F.lit(window)))
    assert one(spark, column) == pytest.approx(score)
    custom = scoring.recurrence_score(F.lit(units), scoring.recurrence_denominator(F.lit(window), F.lit(4)))
    assert one(spark, custom) == pytest.approx(min(100.0, units / 4 * 100))


def scored(spark, impact=None):
    df = spark.createDataFrame([(75.0, 1_000_000, 1, "full_campaign")],
                               "severity_prior double, flow_count bigint, active_observation_units int, window_type string")
    return scoring.with_risk_score(df, impact).first().tlrs_result


def test_score_without_impact(spark):
    r = scored(spark)
    assert r.tlrs_partial_diagnostic == 57.5 and r.tlrs_normalized_heuristic == pytest.approx(67.6471)
    assert (r.tlrs_normalized_rounded, r.evidence_coverage, r.scoring_status) == (68, 0.85, "insufficient_evidence")
    assert r.tlrs_complete is None and r.components.target_impact is None
    assert (r.risk_band, r.provisional_risk_band) == ("Insufficient Evidence", "DIAGNOSTIC_ONLY: High")


def test_score_with_impact(spark):
    r = scored(spark, F.lit(80.0))
    assert (r.tlrs_complete, r.tlrs_complete_rounded, r.evidence_coverage, r.risk_band) == (69.5, 70, 1.0, "High")
    assert r.provisional_risk_band is None
    assert scored(spark, F.lit(500.0)).components.target_impact == 100.0


def test_identifiers_are_stable(spark):
    parts = ["s", "Bot", "a", "b", "full_campaign"]
    expected = hashlib.sha256(":".join(parts).encode()).hexdigest()[:16]
    pid = scoring.profile_id(*[F.lit(p) for p in parts])
    assert one(spark, pid) == expected
    first = one(spark, scoring.snapshot_id(pid, F.lit("r1"), F.lit("m")))
    assert first != one(spark, scoring.snapshot_id(pid, F.lit("r2"), F.lit("m")))
    assert one(spark, scoring.new_run_id()).startswith("run_")


@pytest.mark.parametrize("support,p,r,f,status", [
    (0, None, None, None, "NON_EVALUABLE"), (29, .9, .9, .9, "UNRELIABLE"), (30, .6, .6, .6, "EVALUABLE"),
    (30, .59, .9, .7, "UNRELIABLE"), (99, .9, .9, .9, "EVALUABLE"), (100, .75, .75, .75, "HIGH_RELIABILITY"),
    (100, .74, .9, .8, "EVALUABLE"), (100, None, .9, .8, "UNRELIABLE"), (500, .2, .9, .3, "UNRELIABLE")])
def test_reliability_gates(spark, support, p, r, f, status):
    lit = [F.lit(v).cast("double") for v in (p, r, f)]
    got = one(spark, reliability.assess_reliability(F.lit("Bot"), F.lit(support), *lit))
    assert got.status == status and got.rationale


def test_gating_reasons(spark):
    got = one(spark, reliability.gating_tier(F.lit(10), F.lit(0.5), F.lit(0.9), F.lit(0.6)))
    assert got.tier == "UNRELIABLE"
    assert got.reason == "Validation support (10) < 30; Validation metric below threshold (min=0.5000 < 0.60)"


def test_generalization(spark):
    texts = [one(spark, reliability.generalization(F.lit(v), F.lit(t))) for v, t in ((.5, .52), (.5, .6), (.5, .3))]
    assert texts[0].startswith("Consistent") and "(+10.0%)" in texts[1] and "(-20.0%)" in texts[2]


def advise(spark, label, status=None, rationale=None):
    df = spark.createDataFrame([(label, "insufficient_evidence", "Insufficient Evidence", "DIAGNOSTIC_ONLY: Informational",
                                 ["t1"], status, rationale)],
                               "l string, s string, b string, p string, m array<string>, rs string, rr string")
    return df.select(adv.advisories("l", "s", "b", "p", "m", "rs", "rr").alias("x")).first().x


@pytest.mark.parametrize("label,prefix", [
    ("DDoS-HOIC", "RATE_LIMIT"), ("DoS-Hulk", "RATE_LIMIT"), ("SSH-BruteForce", "INVESTIGATE_AUTH"),
    ("Brute Force - XSS", "INVESTIGATE_AUTH"), ("Bot", "INVESTIGATE_C2"), ("Infiltration", "ENRICH_PAYLOAD"),
    ("SQL Injection", "ENRICH_PAYLOAD")])
def test_category_advisories(spark, label, prefix):
    got = advise(spark, label)
    clean = label.replace(" ", "_").replace("-", "_").upper()
    digest = hashlib.sha256(f"{prefix}:{clean}".encode()).hexdigest()[:6]
    assert got[0].recommendation_id == f"REC-{prefix}-{clean}-{digest}"
    assert got[0].priority == "Low" and got[0].missing_evidence_required == ["t1"]
    assert got[1].recommendation_id.startswith("REC-ENRICH_ASSET") and got[1].priority == "Medium"
    assert len(got) == 2 and all(a.analyst_validation_required for a in got)


def test_weak_classifier_advisory(spark):
    got = advise(spark, "Benign", "UNRELIABLE", "too few rows")
    assert [a.action_type for a in got] == ["Telemetry Enrichment", "Investigation"]
    assert got[1].detailed_guidance.startswith(
        "The ML classifier's validation reliability for 'Benign' is 'UNRELIABLE' (too few rows). Analysts must")
    assert len(advise(spark, "Benign", "EVALUABLE", "ok")) == 1


def test_technique_table_matches_classes():
    assert {t[0] for t in dims.TECHNIQUE_MAPPINGS} == set(dims.CLASS_LABELS) == set(dims.SEVERITY_PRIORS)
    # one asset advisory per class plus one category advisory per attack class
    assert 1 + 2 * (dims.NUM_CLASSES - 1) == 27


def test_category_normalization(spark):
    labels = ["Benign", " Infilteration ", "Infiltration", "ZeroDay", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    got = normalize_category(df).orderBy("i").collect()
    assert [r.canonical_label for r in got] == ["Benign", "Infiltration", "Infiltration", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [r.is_attack for r in got] == [False, True, True, None, None, None]
    assert [r.is_mapped for r in got] == [True, True, True, False, False, False]


def test_index_to_label(spark):
    got = [one(spark, index_to_label(F.lit(v).cast("double"))) for v in (0, 13, 14, -1, 1.5)]
    assert got == ["Benign", "SSH-BruteForce", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_half_open_window(spark):
    start, end = F.lit("2018-02-14").cast("timestamp"), F.lit("2018-02-15").cast("timestamp")
    assert one(spark, timeparse.in_window(start, start, end)) is True
    assert one(spark, timeparse.in_window(end, start, end)) is False


@pytest.mark.parametrize("text,ok", [
    ("2018-02-14T08:31:01", True), ("2018-02-14 08:31:01", True), ("14/02/2018 08:31:01", True), ("2018-02-14", True),
    ("2018-02-14T08:31:01.250000", True), ("noon", False)])
def test_multi_format_timestamps(spark, text, ok):
    assert (one(spark, timeparse.parse_timestamp(F.lit(text))) is not None) == ok
    if not ok:
        with pytest.raises(Exception, match="Unable to parse"):
            one(spark, timeparse.parse_timestamp(F.lit(text), required=True))


def test_display_columns(spark):
    sizes = [(0, "0 Bytes"), (512, "512 Bytes"), (1536, "1.5 KB"), (1048576, "1 MB"), (1099511627776 * 3, "3 TB")]
    for size, text in sizes:
        assert one(spark, display.byte_label(F.lit(size).cast("bigint"))) == text
    assert one(spark, display.display_band(F.lit("High"), F.lit(False))) == "Insufficient Evidence"
    assert one(spark, display.display_band(F.lit("High"), F.lit(True))) == "High"
    assert one(spark, display.display_band(F.lit(""), F.lit(True))) == "Unknown"
    assert one(spark, display.mapping_status_label(F.lit("VERIFIED"))) == "Verified Attribution"
    assert one(spark, display.cell_severity(F.lit(False), F.lit(0.05))) == "error_moderate"
    assert one(spark, display.clean_feature_name(F.lit("flow_duration__imp"))) == "flow_duration"
    assert one(spark, display.clean_feature_name(F.lit("protocol_idx"))) == "protocol"
