"""Evaluation queries over deterministic pseudo-predictions."""

from pyspark.sql import functions as F

from catalog import query
from catalog.ctes import (
    binary_metrics, cells, class_metrics, one_vs_rest, overall_metrics, support, values, with_ctes,
)
from catalog.views import predictions, table
from flowintel import dims
from flowintel.functions.labels import index_to_label
from flowintel.operators import evaluate, thresholds
from flowintel.plans import jobs

SWEEP = thresholds.GRID_STEPS


@query("contingency", with_ctes("SELECT * FROM cells", "cells"))
def contingency(spark, sf):
    return evaluate.contingency(predictions(spark, sf))


@query("rows_outside_matrix", with_ctes(
    "SELECT count(*) AS total_rows, count(*) FILTER (WHERE label_idx<0) AS label_outside,"
    " count(*) FILTER (WHERE prediction NOT BETWEEN 0 AND 13) AS prediction_outside,"
    " count(*) FILTER (WHERE label_idx<0 OR prediction NOT BETWEEN 0 AND 13) AS rows_outside FROM predictions", "predictions"))
def rows_outside_matrix(spark, sf):
    return evaluate.outside_matrix(predictions(spark, sf))


_CLASS = """class_index, class_name, true_support, predicted_support, true_positives, precision, recall, f1_score,
 zero_test_support, zero_predictions"""


@query("class_metrics", with_ctes(f"SELECT {_CLASS} FROM metrics", "metrics"))
def class_metrics_query(spark, sf):
    return evaluate.class_metrics(evaluate.contingency(predictions(spark, sf)))


@query("class_metrics_by_split", with_ctes(f"SELECT split, {_CLASS} FROM split_metrics", "split_metrics"))
def class_metrics_by_split(spark, sf):
    return evaluate.class_metrics(evaluate.contingency(predictions(spark, sf), by=["split"]), ["split"])


@query("overall_metrics", with_ctes(overall_metrics("split_metrics", "split"), "split_metrics"))
def overall_metrics_query(spark, sf):
    rows = evaluate.contingency(predictions(spark, sf), by=["split"])
    return evaluate.overall_metrics(evaluate.class_metrics(rows, ["split"]), ["split"])


@query("binary_metrics", with_ctes(binary_metrics("split_cells", "split"), "split_cells"))
def binary_metrics_query(spark, sf):
    rows = evaluate.contingency(predictions(spark, sf), by=["split"])
    return evaluate.binary_metrics(evaluate.class_metrics(rows, ["split"]), ["split"])


_SEVERITY = """CASE WHEN true_idx=pred_idx THEN CASE WHEN normalized_ratio>=0.95 THEN 'recall_strong' WHEN normalized_ratio>=0.7 THEN 'recall_good'
 WHEN normalized_ratio>=0.3 THEN 'recall_weak' ELSE 'recall_poor' END WHEN normalized_ratio>=0.2 THEN 'error_severe'
 WHEN normalized_ratio>=0.05 THEN 'error_moderate' WHEN normalized_ratio>0 THEN 'error_minor' ELSE 'none' END"""


@query("confusion_matrix", with_ctes(f"SELECT *, {_SEVERITY} AS severity FROM dense", "dense"))
def confusion_matrix(spark, sf):
    return evaluate.dense_matrix(evaluate.contingency(predictions(spark, sf), by=["split"]), ["split"])


@query("one_vs_rest", with_ctes(one_vs_rest("split_cells", "split"), "split_cells", "classes"))
def one_vs_rest_query(spark, sf):
    return evaluate.one_vs_rest_metrics(evaluate.contingency(predictions(spark, sf), by=["split"]), ["split"])


def _macro_sql(source: str) -> str:
    return f"""SELECT round(avg(p),8) AS macro_precision_all, round(avg(r),8) AS macro_recall_all,
 round(avg(coalesce(2*p*r/nullif(p+r,0),0)),8) AS macro_f1_all,
 round((SELECT sum(n) FILTER (WHERE true_idx<>0 AND pred_idx<>0)::DOUBLE/sum(n) FILTER (WHERE true_idx<>0) FROM {source}),8) AS threat_recall,
 round((SELECT sum(n) FILTER (WHERE true_idx=0 AND pred_idx<>0)::DOUBLE/sum(n) FILTER (WHERE true_idx=0) FROM {source}),8) AS benign_fpr
 FROM (SELECT coalesce(true_positives::DOUBLE/nullif(predicted_support,0),0) AS p,
 coalesce(true_positives::DOUBLE/nullif(true_support,0),0) AS r FROM ({support(source)}))"""


@query("macro_metrics", with_ctes(_macro_sql("cells"), "cells", "classes"))
def macro_metrics(spark, sf):
    result = evaluate.macro_metrics(evaluate.contingency(predictions(spark, sf)))
    return result.select(*[F.round(c, 8).alias(c) for c in result.columns])


_SHOWN = "support predicted_support precision recall f1_score specificity fpr fnr tp fp fn tn".split()


def _delta_text():
    shown = "printf('%.1f', floor((t.f1_score-v.f1_score)*100*10.0::DOUBLE+0.5)/10.0)"
    return (f"CASE WHEN abs(t.f1_score-v.f1_score)<0.05 THEN 'Consistent generalization across validation and test splits'"
            f" WHEN t.f1_score-v.f1_score>0.05 THEN 'Higher test generalization (+' || {shown} || '%)'"
            f" ELSE 'Generalization drop on test split (' || {shown} || '%)' END")


_LOW = "least(v.precision,v.recall,v.f1_score)"


@query("model_diagnostics", with_ctes(
    "SELECT v.class_index, v.class_name, CASE WHEN v.support=0 THEN 'NON_EVALUABLE'"
    f" WHEN v.support>=100 AND {_LOW}>=0.75 THEN 'HIGH_RELIABILITY' WHEN v.support>=30 AND {_LOW}>=0.6 THEN 'EVALUABLE' ELSE 'UNRELIABLE' END AS official_reliability_tier,"
    " CASE WHEN v.support=0 THEN 'Zero validation observations (Support = 0)'"
    f" WHEN v.support>=100 AND {_LOW}>=0.75 THEN 'Validation support >= 100 and min(P,R,F1) >= 0.75'"
    f" WHEN v.support>=30 AND {_LOW}>=0.6 THEN 'Validation support >= 30 and min(P,R,F1) >= 0.60'"
    " ELSE concat_ws('; ', CASE WHEN v.support<30 THEN 'Validation support (' || v.support || ') < 30' END,"
    f" CASE WHEN {_LOW}<0.6 THEN 'Validation metric below threshold (min=' || printf('%.4f', floor({_LOW}*10000.0::DOUBLE+0.5)/10000.0) || ' < 0.60)' END) END AS gating_reason,"
    f" {_delta_text()} AS generalization_assessment, "
    + ", ".join(f"v.{c} AS validation_{c}" for c in _SHOWN) + ", " + ", ".join(f"t.{c} AS test_{c}" for c in _SHOWN)
    + f" FROM ({one_vs_rest('split_cells', 'split')}) v JOIN ({one_vs_rest('split_cells', 'split')}) t"
      " ON v.class_index=t.class_index AND v.split='val' AND t.split='test'", "split_cells", "classes"))
def model_diagnostics(spark, sf):
    return evaluate.diagnostics(evaluate.contingency(predictions(spark, sf), by=["split"]))


@query("prediction_labels", with_ctes(
    "SELECT CASE WHEN l_partkey%40=0 THEN 'UNKNOWN' ELSE coalesce(k.class_name,'UNKNOWN') END AS inferred_label, count(*) AS flow_count"
    " FROM predictions p LEFT JOIN classes k ON p.prediction=k.class_index GROUP BY 1", "predictions", "classes"))
def prediction_labels(spark, sf):
    shifted = F.when(F.col("l_partkey") % 40 == 0, F.col("prediction") + 20).otherwise(F.col("prediction"))
    return predictions(spark, sf).groupBy(index_to_label(shifted).alias("inferred_label")).agg(
        F.count("*").alias("flow_count"))


def with_probabilities(df):
    """Probability arrays from the score: null, short and NaN ones included."""
    score, key = F.col("score"), F.col("l_partkey")
    full = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.when(
        i == F.col("prediction").cast("int"), F.when(key % 83 == 0, float("nan")).otherwise(score)
    ).otherwise((1 - score) / 13))
    p = F.when(key % 97 == 0, F.lit(None)).when(key % 89 == 0, F.slice(full, 1, 2)).otherwise(full)
    return df.withColumn("probability", p)


@query("threshold_policy", with_ctes(
    "SELECT prediction, CASE WHEN l_partkey%97<>0 AND l_partkey%89<>0 AND l_partkey%83<>0"
    " THEN adjusted_prediction ELSE prediction END AS adjusted_prediction, count(*) AS flow_count FROM adjusted GROUP BY 1,2", "adjusted"))
def threshold_policy(spark, sf):
    rows = with_probabilities(predictions(spark, sf))
    return thresholds.apply_threshold_policy(rows).groupBy("prediction", "adjusted_prediction").agg(
        F.count("*").alias("flow_count"))


@query("policy_comparison", with_ctes(
    "SELECT " + ", ".join(f"max({c}) FILTER (WHERE rule='{r}') AS {r}_{c}" for r in ("baseline", "policy") for c in (
        "overall_accuracy", "macro_f1", "balanced_accuracy", "benign_recall", "false_alarm_rate", "attack_detection_rate",
        "attack_precision", "attack_f1_score", "false_positives_alarms"))
    + ", round(max(overall_accuracy) FILTER (WHERE rule='policy')-max(overall_accuracy) FILTER (WHERE rule='baseline'),4) AS accuracy_gain,"
      " round(max(attack_detection_rate) FILTER (WHERE rule='policy')-max(attack_detection_rate) FILTER (WHERE rule='baseline'),4) AS attack_recall_change,"
      " max(false_positives_alarms) FILTER (WHERE rule='baseline')-max(false_positives_alarms) FILTER (WHERE rule='policy') AS false_alarms_removed,"
      " round((max(false_positives_alarms) FILTER (WHERE rule='baseline')-max(false_positives_alarms) FILTER (WHERE rule='policy'))::DOUBLE/"
      " max(false_positives_alarms) FILTER (WHERE rule='baseline')*100,1) AS false_alarm_reduction_pct,"
      " max(attack_detection_rate) FILTER (WHERE rule='policy')>=0.95 AS meets_attack_recall_target"
    + f" FROM ({overall_metrics('rule_metrics', 'rule')}) o JOIN ({binary_metrics('rule_cells', 'rule')}) b USING (rule)",
    "rule_metrics"))
def policy_comparison(spark, sf):
    adjusted = thresholds.apply_score_policy(predictions(spark, sf), "score")
    return thresholds.policy_comparison(thresholds.policy_cells(adjusted))


@query("policy_class_comparison", with_ctes(
    "SELECT class_index, class_name, max(true_support) AS support, " + ", ".join(
        f"max({c}) FILTER (WHERE rule='{r}') AS {p}_{c}" for r, p in (("baseline", "base"), ("policy", "policy"))
        for c in ("precision", "recall", "f1_score")) + " FROM rule_metrics GROUP BY 1,2", "rule_metrics"))
def policy_class_comparison(spark, sf):
    adjusted = thresholds.apply_score_policy(predictions(spark, sf), "score")
    return thresholds.policy_class_comparison(thresholds.policy_cells(adjusted))


def _sweep_sql(rows: str = "") -> tuple[str, str, str]:
    """Body, ruled cells and keys of the sweep over the predictions that meet the condition `rows`."""
    rules = values((i * len(SWEEP) + j, float(a), float(b)) for i, a in enumerate(SWEEP) for j, b in enumerate(SWEEP))
    grouped = "SELECT label_idx::INTEGER AS t, prediction::INTEGER AS p, score AS s, count(*) AS c FROM predictions" \
              f" WHERE {rows}label_idx BETWEEN 0 AND 13 AND prediction BETWEEN 0 AND 13 GROUP BY 1,2,3"
    ruled = (f"SELECT g.candidate_id, g.tau_infiltration, g.tau_brute_force_web, t AS true_idx, CASE WHEN (p=11 AND s<tau_infiltration) OR"
             f" (p=2 AND s<tau_brute_force_web) THEN 0 ELSE p END AS pred_idx, CAST(sum(c) AS BIGINT) AS n FROM ({grouped}) x"
             f" CROSS JOIN (VALUES {rules}) g(candidate_id, tau_infiltration, tau_brute_force_web) GROUP BY ALL")
    keys = "candidate_id, tau_infiltration, tau_brute_force_web"
    return (f"SELECT {keys}, overall_accuracy AS accuracy, macro_f1, benign_recall, false_alarm_rate AS false_positive_rate,"
            " attack_detection_rate AS attack_recall, attack_precision, false_positives_alarms, true_positives_detected,"
            f" benign_total, attack_total FROM sweep_binary JOIN sweep_overall USING ({keys})"), ruled, keys


def _sweep_ctes(body: str, rows: str = "") -> str:
    head, (sweep, ruled, keys) = with_ctes("", "predictions", "classes").rstrip(), _sweep_sql(rows)
    return (head + f",\nsweep_cells AS ({ruled}),\nsweep_classes AS ({class_metrics('sweep_cells', keys)}),\n"
            f"sweep_overall AS ({overall_metrics('sweep_classes', keys)}),\nsweep_binary AS ({binary_metrics('sweep_cells', keys)}),\n"
            f"sweep AS ({sweep})\n{body}")


@query("threshold_sweep", _sweep_ctes("SELECT * FROM sweep"))
def threshold_sweep(spark, sf):
    """All rules on the rows of all parts."""
    return thresholds.threshold_sweep(predictions(spark, sf), "score")


@query("threshold_selection", _sweep_ctes(
    "SELECT (SELECT count(*) FROM sweep) AS total_candidates, (SELECT count(*) FROM sweep WHERE true_positives_detected::DOUBLE/attack_total>=0.9)"
    " AS eligible_candidates_count, s.* FROM sweep s WHERE true_positives_detected::DOUBLE/attack_total>=0.9"
    " ORDER BY false_positives_alarms, true_positives_detected DESC, candidate_id LIMIT 1"))
def threshold_selection(spark, sf):
    """The rule selected on the rows of all parts; threshold_study searches on validation rows only."""
    return thresholds.select_thresholds(thresholds.threshold_sweep(predictions(spark, sf), "score"), 0.9)


_CHOSEN = """chosen AS (SELECT tau_infiltration AS a, tau_brute_force_web AS b FROM sweep
 WHERE true_positives_detected::DOUBLE/attack_total>=0.9 ORDER BY false_positives_alarms, true_positives_detected DESC, candidate_id LIMIT 1),
judged AS (SELECT label_idx::INTEGER AS true_idx, prediction::INTEGER AS p, score FROM predictions WHERE split='test'
 AND label_idx BETWEEN 0 AND 13 AND prediction BETWEEN 0 AND 13),
study_cells AS (SELECT 'baseline' AS rule, true_idx, p AS pred_idx, count(*) AS n FROM judged GROUP BY ALL UNION ALL
 SELECT 'policy', true_idx, CASE WHEN (p=11 AND score<a) OR (p=2 AND score<b) THEN 0 ELSE p END AS pred_idx, count(*)
 FROM judged LEFT JOIN chosen ON true GROUP BY ALL)"""


@query("threshold_study", _sweep_ctes("", "split='val' AND ").rstrip() + f", {_CHOSEN},\nstudy_classes AS ({class_metrics('study_cells', 'rule')}) "
       "SELECT class_index, class_name, max(true_support) AS support, " + ", ".join(
           f"max({c}) FILTER (WHERE rule='{r}') AS {p}_{c}" for r, p in (("baseline", "base"), ("policy", "policy"))
           for c in ("precision", "recall", "f1_score")) + " FROM study_classes GROUP BY 1,2")
def threshold_study(spark, sf):
    """The rule chosen on validation rows beside the plain predictions, per class of the test rows."""
    return jobs.threshold_report(predictions(spark, sf), "score", 0.9)["classes"]


@query("benign_fp_by_date", with_ctes(
    "SELECT split, event_date::VARCHAR AS event_date, count(*) AS total, " + ", ".join(
        f"count(*) FILTER (WHERE {c}<>0) AS {p}_fp, count(*) FILTER (WHERE {c}=11) AS {p}_fp_infil,"
        f" count(*) FILTER (WHERE {c}=2) AS {p}_fp_web" for p, c in (("baseline", "prediction"), ("thresh", "adjusted_prediction")))
    + " FROM adjusted WHERE label_idx=0 GROUP BY 1,2", "adjusted"))
def benign_fp_by_date(spark, sf):
    adjusted = thresholds.apply_score_policy(predictions(spark, sf), "score")
    return evaluate.benign_false_positives(adjusted, by=["split"]).withColumn(
        "event_date", F.col("event_date").cast("string"))


@query("score_histogram", with_ctes(
    "SELECT b::INTEGER AS bin, b::DOUBLE/10 AS bin_start, (b+1)::DOUBLE/10 AS bin_end,"
    " count(*) FILTER (WHERE label_idx=0) AS benign_count, count(*) FILTER (WHERE label_idx=11) AS infil_count"
    " FROM range(10) r(b) LEFT JOIN predictions p ON least(floor(score*10),9)=b AND label_idx IN (0,11) GROUP BY 1,2,3", "predictions"))
def score_histogram(spark, sf):
    return evaluate.score_histogram(predictions(spark, sf), "score", "label_idx", {"benign": 0, "infil": 11})


_AUC = ("SELECT {by}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,"
        " round(sum(pos*(below+neg/2.0::DOUBLE))/(sum(pos)::DOUBLE*sum(neg)),6) AS auc FROM (SELECT *,"
        " coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::DOUBLE AS below FROM ({counts})){group}")


@query("one_vs_benign_auc", with_ctes(_AUC.format(by="", part="", group="", counts=(
    "SELECT score, count(*) FILTER (WHERE label_idx=11) AS pos, count(*) FILTER (WHERE label_idx=0) AS neg FROM predictions"
    " WHERE label_idx IN (0,11) GROUP BY 1")), "predictions"))
def one_vs_benign_auc(spark, sf):
    found = evaluate.one_vs_benign_auc(predictions(spark, sf), "score", dims.CLASS_INDEX["Infiltration"])
    return found.withColumn("auc", F.round("auc", 6))


@query("event_value_auc", _AUC.format(by="event_type, ", part="PARTITION BY event_type ", group=" GROUP BY 1", counts=(
    "SELECT event_type, value::DOUBLE AS score, count(*) FILTER (WHERE user_id%3=0) AS pos, count(*) FILTER (WHERE user_id%3<>0) AS neg"
    " FROM events WHERE value IS NOT NULL AND NOT isnan(value::DOUBLE) GROUP BY 1,2")))
def event_value_auc(spark, sf):
    """How well an event's value tells the users apart, per event type; scores far outside [0, 1]."""
    found = evaluate.rank_sum_auc(table(spark, sf, "events"), "value", F.col("user_id") % 3 == 0, ["event_type"])
    return found.withColumn("auc", F.round("auc", 6))


@query("quality_contingency",
       "SELECT toxic AS true_idx, quality AS pred_idx, count(*) AS n FROM labels GROUP BY 1,2")
def quality_contingency(spark, sf):
    return evaluate.contingency(table(spark, sf, "labels"), "toxic", "quality")


@query("quality_binary_metrics", "WITH c AS (" + cells("labels", pred="quality").replace("label_idx", "toxic") + ") " + binary_metrics("c"))
def quality_binary_metrics(spark, sf):
    return evaluate.binary_metrics(evaluate.class_metrics(
        evaluate.contingency(table(spark, sf, "labels"), "toxic", "quality")))
