"""Aggregate, risk, profile and lookup queries."""

from pyspark.sql import functions as F

from catalog import query
from catalog.ctes import (
    BAND, MANIFEST, RUN_ID, categorized, scored, short_hash, values, with_ctes,
)
from catalog.views import campaign_profiles, flows, predictions, table
from flowintel import dims
from flowintel.functions import advisories as adv
from flowintel.functions import display, reliability, scoring
from flowintel.functions.labels import normalize_category
from flowintel.operators import evaluate, lookups, profiles, results
from flowintel.plans.jobs import reliability_table
from flowintel.session import checkpointed

_TIME = "yyyy-MM-dd HH:mm:ss"


def _times_as_text(df):
    return df.withColumns({c: F.date_format(c, _TIME) for c in (
        "window_start", "window_end", "first_seen_timestamp", "last_seen_timestamp")})


def _aggregate_sql(name: str) -> str:
    times = ", ".join(f"strftime({c},'%Y-%m-%d %H:%M:%S') AS {c}" for c in (
        "window_start", "window_end", "first_seen_timestamp", "last_seen_timestamp"))
    return with_ctes(f"SELECT * REPLACE({times}) FROM {name}", name)


@query("flow_aggregates", _aggregate_sql("campaign_aggregates"))
def flow_aggregates(spark, sf):
    return _times_as_text(profiles.flow_aggregates(flows(spark, sf)))


@query("flow_aggregates_daily", _aggregate_sql("daily_aggregates"))
def flow_aggregates_daily(spark, sf):
    return _times_as_text(profiles.flow_aggregates(flows(spark, sf), "daily"))


@query("flow_aggregates_hourly", _aggregate_sql("hourly_aggregates"))
def flow_aggregates_hourly(spark, sf):
    return _times_as_text(profiles.flow_aggregates(flows(spark, sf), "hourly"))


@query("event_window_counts",
       "SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts),'%Y-%m-%d %H:%M:%S') AS window_start,"
       " count(*) AS flow_count, round(sum(value),4) AS total_value FROM events GROUP BY 1,2")
def event_window_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(
        F.count("*").alias("flow_count"), F.round(F.sum("value"), 4).alias("total_value")
    ).select("event_type", F.date_format("w.start", _TIME).alias("window_start"), "flow_count", "total_value")


_SCORE_SQL = """severity, frequency, recurrence, round(partial,4) AS partial_score, round(normalized,4) AS normalized_score,
 tlrs_normalized_rounded AS normalized_rounded"""


def _score_columns(df):
    t = "tlrs_result"
    return df.select(
        "canonical_label", "window_type", "flow_count", "active_observation_units",
        F.col(f"{t}.components.severity"), F.round(f"{t}.components.frequency", 8).alias("frequency"),
        F.col(f"{t}.components.recurrence"), F.col(f"{t}.tlrs_partial_diagnostic").alias("partial_score"),
        F.col(f"{t}.tlrs_normalized_heuristic").alias("normalized_score"),
        F.col(f"{t}.tlrs_normalized_rounded").alias("normalized_rounded"),
        F.col(f"{t}.tlrs_complete").alias("complete_score"), F.col(f"{t}.tlrs_complete_rounded").alias("complete_rounded"),
        F.col(f"{t}.evidence_coverage"), F.col(f"{t}.scoring_status"), F.col(f"{t}.risk_band"),
        F.col(f"{t}.provisional_risk_band"))


def _score_sql(source: str, has_impact: bool) -> str:
    tail = (
        "round(complete,4) AS complete_score, tlrs_complete_rounded AS complete_rounded, 1.0::DOUBLE AS evidence_coverage,"
        " 'complete' AS scoring_status, complete_band AS risk_band, NULL::VARCHAR AS provisional_risk_band"
        if has_impact else
        "NULL::DOUBLE AS complete_score, NULL::INTEGER AS complete_rounded, 0.85::DOUBLE AS evidence_coverage,"
        " 'insufficient_evidence' AS scoring_status, 'Insufficient Evidence' AS risk_band,"
        " 'DIAGNOSTIC_ONLY: ' || provisional AS provisional_risk_band")
    return (f"SELECT canonical_label, window_type, flow_count, active_observation_units, "
            f"{_SCORE_SQL.replace('severity, frequency', 'severity, round(frequency,8) AS frequency')}, {tail} FROM {source}")


@query("risk_scores", with_ctes(_score_sql("campaign_scored", False), "campaign_scored"))
def risk_scores(spark, sf):
    aggregates = profiles.flow_aggregates(flows(spark, sf))
    return _score_columns(profiles.add_risk_score(normalize_category(aggregates)))


@query("risk_scores_daily", with_ctes(_score_sql("daily_scored", False), "daily_scored"))
def risk_scores_daily(spark, sf):
    aggregates = profiles.flow_aggregates(flows(spark, sf), "daily")
    return _score_columns(profiles.add_risk_score(normalize_category(aggregates)))


_IMPACT = "(flow_count%140-20)::DOUBLE"


@query("risk_scores_with_impact", with_ctes(_score_sql(
    "(" + scored("hourly_aggregates", f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, {_IMPACT}))") + ")", True),
    "hourly_aggregates", "category_lookup", "severity"))
def risk_scores_with_impact(spark, sf):
    aggregates = profiles.flow_aggregates(flows(spark, sf), "hourly")
    impact = (F.col("flow_count") % 140 - 20).cast("double")
    return _score_columns(profiles.add_risk_score(normalize_category(aggregates), impact))


@query("profile_ids", with_ctes(
    "SELECT canonical_label, window_type, window_start, window_end, profile_id, snapshot_id FROM hourly_profiles",
    "hourly_profiles"))
def profile_ids(spark, sf):
    return campaign_profiles(spark, sf, "hourly").select(
        F.col("category.canonical_label").alias("canonical_label"), "window_type", "window_start", "window_end",
        "profile_id", "snapshot_id")


@query("technique_mapping", with_ctes(
    "SELECT canonical_label, technique_id, technique_name, tactic, mapping_status, rationale,"
    " array_to_string(missing_telemetry,'; ') AS missing_telemetry, flow_count FROM campaign_profiles", "campaign_profiles"))
def technique_mapping(spark, sf):
    labelled = normalize_category(profiles.flow_aggregates(flows(spark, sf)))
    return profiles.add_technique(labelled).select(
        "canonical_label", "technique_id", "technique_name", "tactic", "mapping_status", "rationale",
        F.array_join("missing_telemetry", "; ").alias("missing_telemetry"), "flow_count")


@query("profile_status_counts", with_ctes(
    "SELECT count(*) AS total_profiles_generated, count(*) FILTER (WHERE is_attack) AS attack_categories_count,"
    " count(*) FILTER (WHERE NOT is_attack) AS benign_categories_count,"
    " count(*) FILTER (WHERE is_attack IS NULL) AS unknown_categories_count FROM hourly_profiles", "hourly_profiles"))
def profile_status_counts(spark, sf):
    return profiles.status_counts(campaign_profiles(spark, sf, "hourly"))


@query("traffic_composition", with_ctes(
    "SELECT attack_status, flow_count, CAST(sum(flow_count) OVER () AS BIGINT) AS total_flows,"
    " round(flow_count::DOUBLE/sum(flow_count) OVER ()*100,1) AS percentage FROM"
    " (SELECT attack_status, CAST(sum(flow_count) AS BIGINT) AS flow_count FROM daily_profiles GROUP BY 1)", "daily_profiles"))
def traffic_composition(spark, sf):
    return profiles.traffic_composition(campaign_profiles(spark, sf, "daily"))


@query("category_share", with_ctes(
    "SELECT canonical_label, attack_status, flow_count, round(flow_count::DOUBLE/sum(flow_count) OVER ()*100,2) AS percentage"
    " FROM campaign_profiles", "campaign_profiles"))
def category_share(spark, sf):
    return profiles.category_share(campaign_profiles(spark, sf))


@query("mapping_status_counts", with_ctes(
    "SELECT count(*) FILTER (WHERE mapping_status='candidate') AS candidate_count,"
    " count(*) FILTER (WHERE mapping_status='unverified') AS unverified_count,"
    " count(*) FILTER (WHERE mapping_status='verified') AS verified_count,"
    " count(*) FILTER (WHERE mapping_status='not_applicable') AS not_applicable_count FROM daily_profiles", "daily_profiles"))
def mapping_status_counts(spark, sf):
    return profiles.mapping_status_counts(campaign_profiles(spark, sf, "daily"))


@query("candidate_mappings", with_ctes(
    "SELECT canonical_label, technique_id, 'Candidate Profile' AS status_label FROM campaign_profiles"
    " WHERE lower(mapping_status)='candidate'", "campaign_profiles"))
def candidate_mappings(spark, sf):
    found = profiles.filter_by_mapping_status(campaign_profiles(spark, sf), "Candidate")
    return found.select(
        F.col("category.canonical_label").alias("canonical_label"), F.col("mitre_mapping.technique_id"),
        display.mapping_status_label(F.col("mitre_mapping.mapping_status")).alias("status_label"))


@query("recurrence_grid", with_ctes(
    "SELECT canonical_label, attack_status, slot::INTEGER AS slot, 'D' || (slot+1) AS slot_label,"
    " (slot<active_observation_units)::INTEGER AS active, CASE WHEN attack_status='ATTACK' THEN 0 ELSE 1 END AS status_order,"
    " active_observation_units FROM campaign_profiles, unnest(range(0,recurrence_denominator)) u(slot)", "campaign_profiles"))
def recurrence_grid(spark, sf):
    return profiles.recurrence_grid(campaign_profiles(spark, sf))


_TEXT = {
    "RATE_LIMIT": adv.RATE_LIMIT, "INVESTIGATE_AUTH": adv.INVESTIGATE_AUTH, "INVESTIGATE_C2": adv.INVESTIGATE_C2,
    "ENRICH_PAYLOAD": adv.ENRICH_PAYLOAD, "ENRICH_ASSET": adv.ENRICH_ASSET,
}
_CLEAN_CATEGORY = "upper(translate(canonical_label,' -','__'))"
_CATEGORY_RULE = """CASE WHEN contains(canonical_label,'DoS') THEN 'RATE_LIMIT' WHEN contains(canonical_label,'Brute') THEN 'INVESTIGATE_AUTH'
 WHEN canonical_label='Bot' THEN 'INVESTIGATE_C2' WHEN canonical_label IN ('Infiltration','SQL Injection') THEN 'ENRICH_PAYLOAD' END"""


def _advisory_sql(source: str) -> str:
    rules = values((k, v[1], v[2], v[3]) for k, v in _TEXT.items())
    return f"""SELECT p.snapshot_id, p.position, 'REC-' || p.prefix || '-' || {_CLEAN_CATEGORY} || '-' ||
 substr(sha256(p.prefix || ':' || {_CLEAN_CATEGORY}),1,6) AS recommendation_id, p.canonical_label AS threat_category,
 p.priority, r.action_type, r.summary, r.detailed_guidance, p.missing_evidence_required,
 true AS analyst_validation_required, false AS is_automated_action FROM (
 SELECT snapshot_id, canonical_label, 0 AS position, {_CATEGORY_RULE} AS prefix,
 CASE WHEN provisional='Informational' THEN 'Low' ELSE provisional END AS priority,
 array_to_string(missing_telemetry,'; ') AS missing_evidence_required FROM {source} WHERE {_CATEGORY_RULE} IS NOT NULL
 UNION ALL SELECT snapshot_id, canonical_label, CASE WHEN {_CATEGORY_RULE} IS NULL THEN 0 ELSE 1 END, 'ENRICH_ASSET', 'Medium',
 'Destination host asset criticality; Device role classification' FROM {source}) p
 JOIN (VALUES {rules}) r(prefix, action_type, summary, detailed_guidance) ON p.prefix=r.prefix"""


@query("advisories", with_ctes(_advisory_sql("daily_profiles"), "daily_profiles"))
def advisories(spark, sf):
    return results.advisory_rows(campaign_profiles(spark, sf, "daily")).drop("run_id").withColumn(
        "missing_evidence_required", F.array_join("missing_evidence_required", "; "))


@query("advisory_ids", with_ctes(
    f"SELECT label, 'REC-VERIFY_ML-' || {_CLEAN_CATEGORY} || '-' || substr(sha256('VERIFY_ML:' || {_CLEAN_CATEGORY}),1,6) AS recommendation_id"
    " FROM (SELECT DISTINCT label, label AS canonical_label FROM clean)", "clean"))
def advisory_ids(spark, sf):
    labels = flows(spark, sf).select("label").distinct()
    return labels.select("label", adv.recommendation_id("VERIFY_ML", "label").alias("recommendation_id"))


_PROFILE_COLUMNS = """profile_id, snapshot_id, window_type, window_start, window_end, canonical_label, raw_label, attack_status,
 is_attack, is_mapped, flow_count, total_bytes, total_packets, active_observation_units, recurrence_denominator"""


@query("threat_profiles", with_ctes(
    f"SELECT {_PROFILE_COLUMNS}, technique_id, tactic, mapping_status, round(normalized,4) AS normalized_score,"
    " 'Insufficient Evidence' AS risk_band, 'DIAGNOSTIC_ONLY: ' || provisional AS provisional_risk_band,"
    f" CASE WHEN {_CATEGORY_RULE} IS NULL THEN 1 ELSE 2 END AS advisory_count FROM hourly_profiles", "hourly_profiles"))
def threat_profiles(spark, sf):
    return campaign_profiles(spark, sf, "hourly").select(
        "profile_id", "snapshot_id", "window_type", "window_start", "window_end", "category.*", "flow_count",
        "total_bytes", "total_packets", "active_observation_units", "recurrence_denominator",
        F.col("mitre_mapping.technique_id"), F.col("mitre_mapping.tactic"), F.col("mitre_mapping.mapping_status"),
        F.col("tlrs_result.tlrs_normalized_heuristic").alias("normalized_score"), F.col("tlrs_result.risk_band"),
        F.col("tlrs_result.provisional_risk_band"), F.size("advisories").alias("advisory_count"))


# metrics of the two parts judged by the gates
_GATE_INPUT = "SELECT split, class_name, true_support, precision, recall, f1_score FROM split_metrics"


def _fixed3(c):
    return f"printf('%.3f', floor({c}*1000.0::DOUBLE+0.5)/1000.0)"


_METRIC_TEXT = f"'precision=' || {_fixed3('precision')} || ', recall=' || {_fixed3('recall')} || ', F1=' || {_fixed3('f1_score')} || '.'"
_RELIABILITY_SQL = f"""SELECT split, class_name, true_support AS validation_support, precision AS validation_precision,
 recall AS validation_recall, f1_score AS validation_f1,
 CASE WHEN true_support=0 THEN 'NON_EVALUABLE' WHEN true_support<30 OR bad THEN 'UNRELIABLE'
  WHEN true_support>=100 AND low>=0.75 THEN 'HIGH_RELIABILITY' WHEN low>=0.60 THEN 'EVALUABLE' ELSE 'UNRELIABLE' END AS status,
 CASE WHEN true_support=0 THEN 'Class ''' || class_name || ''' had 0 validation instances; model predictions cannot be verified on validation data.'
  WHEN true_support<30 THEN 'Validation support (' || true_support || ') is below the required operational threshold (30).'
  WHEN bad THEN 'Class ''' || class_name || ''' has incomplete validation metrics.'
  WHEN true_support>=100 AND low>=0.75 THEN 'Class ''' || class_name || ''' meets high-reliability validation criteria: support=' || true_support || ', ' || {_METRIC_TEXT}
  WHEN low>=0.60 THEN 'Class ''' || class_name || ''' meets evaluable operational criteria: support=' || true_support || ', ' || {_METRIC_TEXT}
  ELSE 'Class ''' || class_name || ''' validation performance is below operational threshold: ' || {_METRIC_TEXT} END AS rationale
 FROM (SELECT *, precision IS NULL OR recall IS NULL OR f1_score IS NULL AS bad, least(precision,recall,f1_score) AS low FROM ({_GATE_INPUT}))"""


@query("reliability_gate", with_ctes(_RELIABILITY_SQL, "split_metrics"))
def reliability_gate(spark, sf):
    cells = evaluate.contingency(predictions(spark, sf), by=["split"])
    metrics = evaluate.class_metrics(cells, ["split"])
    judged = metrics.withColumn("_a", reliability.assess_reliability(
        F.col("class_name"), F.col("true_support"), F.col("precision"), F.col("recall"), F.col("f1_score")))
    return judged.select(
        "split", "class_name", F.col("true_support").alias("validation_support"),
        F.col("precision").alias("validation_precision"), F.col("recall").alias("validation_recall"),
        F.col("f1_score").alias("validation_f1"), F.col("_a.status"), F.col("_a.rationale"))


@query("profiles_with_reliability", with_ctes(
    "SELECT p.canonical_label, p.window_start, r.status, r.rationale,"
    f" (CASE WHEN {_CATEGORY_RULE.replace('canonical_label', 'p.canonical_label')} IS NULL THEN 1 ELSE 2 END)"
    " + (CASE WHEN r.status IN ('UNRELIABLE','NON_EVALUABLE') THEN 1 ELSE 0 END) AS advisory_count"
    f" FROM daily_profiles p LEFT JOIN ({_RELIABILITY_SQL}) r ON p.canonical_label=r.class_name AND r.split='val'",
    "split_metrics", "daily_profiles"))
def profiles_with_reliability(spark, sf):
    val = predictions(spark, sf).where(F.col("split") == "val")
    judged = reliability_table(evaluate.class_metrics(evaluate.contingency(val)))
    built = profiles.threat_profiles(
        profiles.flow_aggregates(flows(spark, sf), "daily"), MANIFEST, RUN_ID, profiles.CURATED_SOURCE, judged)
    return built.select(
        F.col("category.canonical_label").alias("canonical_label"), "window_start",
        F.col("model_reliability.status"), F.col("model_reliability.rationale"),
        F.size("advisories").alias("advisory_count"))


def _profile_table(spark, sf, window="hourly"):
    return results.profile_rows(campaign_profiles(spark, sf, window))


_ROW_SQL = "SELECT snapshot_id, canonical_label, raw_label, attack_status, window_start, flow_count FROM hourly_profiles"


@query("profile_search", with_ctes(
    _ROW_SQL + " WHERE (lower(canonical_label) LIKE '%brute%' OR lower(raw_label) LIKE '%brute%') AND attack_status='ATTACK'",
    "hourly_profiles"))
def profile_search(spark, sf):
    found = lookups.search_profiles(_profile_table(spark, sf), search="  BRUTE ", attack_status="ATTACK")
    return _short_rows(found)


def _short_rows(df):
    return df.select(
        "snapshot_id", "canonical_label", "raw_label", "attack_status",
        F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"), "flow_count")


@query("profile_page", with_ctes(
    _ROW_SQL + " ORDER BY flow_count DESC, snapshot_id LIMIT 20 OFFSET 40", "hourly_profiles"))
def profile_page(spark, sf):
    return _short_rows(lookups.page_profiles(_profile_table(spark, sf), limit=20, offset=40))


@query("profile_match_total", with_ctes(
    "SELECT count(*) AS total FROM hourly_profiles WHERE is_attack", "hourly_profiles"))
def profile_match_total(spark, sf):
    return lookups.matched_rows(lookups.search_profiles(_profile_table(spark, sf), is_attack=True))


@query("profile_details", with_ctes(
    "SELECT p.snapshot_id, p.canonical_label, p.flow_count, round(p.partial,2) AS partial_score, p.technique_id, p.mapping_status,"
    " false AS risk_confirmed, false AS mapping_confirmed, (SELECT string_agg(a.recommendation_id, ',' ORDER BY a.position) FROM ("
    + _advisory_sql("daily_profiles") + ") a WHERE a.snapshot_id=p.snapshot_id) AS advisories FROM daily_profiles p", "daily_profiles"))
def profile_details(spark, sf):
    # four result tables are read from the same profiles
    tables = results.result_tables(checkpointed(campaign_profiles(spark, sf, "daily")), None)
    detail = lookups.profile_details(
        tables["threat_profiles"], tables["risk_assessments"], tables["mitre_mappings"], tables["advisories"])
    return detail.select(
        "snapshot_id", "canonical_label", "flow_count",
        F.col("tlrs_partial_diagnostic").cast("double").alias("partial_score"), "technique_id", "mapping_status",
        "risk_confirmed", "mapping_confirmed",
        F.array_join(F.transform("advisories", lambda a: a["recommendation_id"]), ",").alias("advisories"))


@query("resolved_tiers", with_ctes(
    "SELECT p.snapshot_id, p.canonical_label, CASE WHEN NOT coalesce(p.is_attack,false) OR p.canonical_label='Benign' THEN 'BASELINE'"
    f" ELSE coalesce(d.tier,'UNMATCHED') END AS resolved_reliability_tier FROM daily_profiles p LEFT JOIN (SELECT class_name,"
    " CASE WHEN true_support=0 THEN 'NON_EVALUABLE' WHEN true_support>=100 AND l>=0.75 THEN 'HIGH_RELIABILITY'"
    " WHEN true_support>=30 AND l>=0.60 THEN 'EVALUABLE' ELSE 'UNRELIABLE' END AS tier FROM"
    " (SELECT *, least(coalesce(precision,0),coalesce(recall,0),coalesce(f1_score,0)) AS l FROM split_metrics WHERE split='val')) d"
    " ON p.canonical_label=d.class_name", "daily_profiles", "split_metrics"))
def resolved_tiers(spark, sf):
    cells = evaluate.contingency(predictions(spark, sf), by=["split"])
    tiers = evaluate.diagnostics(cells).select("class_name", "official_reliability_tier")
    return lookups.with_reliability_tier(_profile_table(spark, sf, "daily"), tiers).select(
        "snapshot_id", "canonical_label", "resolved_reliability_tier")


@query("risk_badges", with_ctes(
    "SELECT snapshot_id, CASE WHEN canonical_label='Benign' THEN 'Insufficient Evidence' WHEN flow_count%5=0 THEN 'Unknown'"
    " ELSE provisional END AS shown_band, CASE WHEN total_bytes=0 THEN '0 Bytes' ELSE"
    " regexp_replace(printf('%.2f', floor(total_bytes/power(1024.0::DOUBLE, e)*100+0.5)/100), '\\.?0+$', '') || ' ' ||"
    " ['Bytes','KB','MB','GB','TB'][e+1] END AS shown_bytes FROM"
    " (SELECT *, least(4, (length(bin(greatest(total_bytes,1)))-1)//10)::INTEGER AS e FROM hourly_profiles)", "hourly_profiles"))
def risk_badges(spark, sf):
    rows = campaign_profiles(spark, sf, "hourly")
    band = F.when(F.col("flow_count") % 5 == 0, "").otherwise(
        F.substring_index("tlrs_result.provisional_risk_band", ": ", -1))
    return rows.select(
        "snapshot_id",
        display.display_band(band, F.col("category.canonical_label") != dims.BENIGN).alias("shown_band"),
        display.byte_label(F.col("total_bytes")).alias("shown_bytes"))


@query("severity_lookup", with_ctes(
    "SELECT c.canonical_label, coalesce(s.prior,50.0) AS severity_prior, CAST(sum(c.flow_count) AS BIGINT) AS flow_count FROM ("
    + categorized("daily_aggregates") + ") c LEFT JOIN severity s ON c.canonical_label=s.label GROUP BY 1,2",
    "daily_aggregates", "category_lookup", "severity"))
def severity_lookup(spark, sf):
    labelled = normalize_category(profiles.flow_aggregates(flows(spark, sf), "daily"))
    return profiles.add_severity(labelled).groupBy("canonical_label", "severity_prior").agg(
        F.sum("flow_count").alias("flow_count"))


@query("frequency_bands",
       "SELECT o_custkey, n, round(least(100.0, log10(n::DOUBLE)/6.0*100.0),8) AS frequency, r, "
       + BAND.format(x="r") + " AS band, " + short_hash("'orders'", "o_custkey::VARCHAR", "'a'", "'b'", "'full_campaign'")
       + " AS profile_id FROM (SELECT *, CAST(floor(log10(n::DOUBLE)/6.0*100.0+0.5) AS INTEGER) AS r FROM"
       " (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))")
def frequency_bands(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    frequency = scoring.frequency_score(F.col("n"))
    rounded = scoring.round_half_up(frequency).cast("int")
    return counts.select(
        "o_custkey", "n", F.round(frequency, 8).alias("frequency"), rounded.alias("r"),
        scoring.risk_band(rounded).alias("band"),
        scoring.profile_id(F.lit("orders"), F.col("o_custkey").cast("string"), F.lit("a"), F.lit("b"), F.lit("full_campaign"))
        .alias("profile_id"))
