import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowintel.operators import evaluate, results, thresholds


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b, n in rows for _ in range(n)], "label_idx double, prediction double")


def test_metrics_with_absent_classes(spark):
    df = pairs(spark, [(0, 0, 8), (0, 1, 2), (1, 0, 1), (1, 1, 9), (-1, 0, 3)])
    cells = evaluate.contingency(df)
    metrics = evaluate.class_metrics(cells)
    rows = {r.class_index: r for r in metrics.collect()}
    assert len(rows) == 14 and rows[5].precision is None and rows[5].f1_score is None and rows[5].zero_test_support
    assert (rows[0].precision, rows[0].recall) == (0.8889, 0.8)
    o = evaluate.overall_metrics(metrics).first()
    assert (o.total_evaluated_samples, o.overall_accuracy, o.majority_class_baseline_accuracy) == (20, 0.85, 0.5)
    b = evaluate.binary_metrics(metrics).first()
    assert (b.false_alarm_rate, b.attack_detection_rate) == (0.2, 0.9)
    assert (b.true_negatives_benign, b.false_positives_alarms, b.false_negatives_missed, b.true_positives_detected) == (8, 2, 1, 9)
    out = evaluate.outside_matrix(df).first()
    assert (out.total_rows, out.rows_outside) == (23, 3)
    s = evaluate.summary_metrics(metrics).first()
    assert s.overall_accuracy == 0.85 and s.attack_detection_rate == 0.9


def test_support_without_prediction_is_zero_f1(spark):
    rows = {r.class_index: r for r in evaluate.class_metrics(evaluate.contingency(pairs(spark, [(2, 0, 4)]))).collect()}
    assert rows[2].precision is None and rows[2].recall == 0.0 and rows[2].f1_score == 0.0


def test_dense_matrix_and_one_vs_rest(spark):
    cells = evaluate.contingency(pairs(spark, [(0, 0, 3), (0, 1, 1), (1, 1, 4)]))
    dense = {(r.true_idx, r.pred_idx): r for r in evaluate.dense_matrix(cells).collect()}
    assert len(dense) == 196 and dense[0, 1].normalized_ratio == 0.25 and dense[7, 7].normalized_ratio == 0.0
    ovr = {r.class_index: r for r in evaluate.one_vs_rest_metrics(cells).collect()}
    assert (ovr[1].tp, ovr[1].fp, ovr[1].fn, ovr[1].tn) == (4, 1, 0, 3)
    assert ovr[1].specificity == 0.75 and ovr[9].precision == 0.0


def test_auc(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.4), (11.0, 0.4), (11.0, 0.9), (3.0, 0.0)], "label_idx double, s double")
    assert tuple(evaluate.one_vs_benign_auc(df, "s", 11).first()) == (2, 2, pytest.approx(0.875))


def test_histogram_last_edge(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 0.05), (11, 0.95)], "k int, s double")
    rows = {r.bin: (r.benign_count, r.infil_count) for r in evaluate.score_histogram(df, "s", "k", {"benign": 0, "infil": 11}).collect()}
    assert len(rows) == 10 and rows[9] == (1, 1) and rows[0] == (1, 0) and rows[5] == (0, 0)


def vector(index, value):
    p = [0.01] * 14
    p[index] = value
    return Vectors.dense(p)


def test_policy_boundaries_and_bad_vectors(spark):
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("prediction", T.DoubleType()), T.StructField("probability", VectorUDT())])
    rows = [
        (0, 11.0, vector(11, 0.59)), (1, 11.0, vector(11, 0.60)), (2, 11.0, vector(11, 0.61)), (3, 2.0, vector(2, 0.34)),
        (4, 2.0, vector(2, 0.35)), (5, 4.0, vector(4, 0.01)), (6, 11.0, None), (7, 11.0, vector(11, float("nan"))),
        (8, 11.0, Vectors.dense([0.1, 0.2])), (9, 0.0, vector(0, 0.1))]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.prediction, r.adjusted_prediction) for r in thresholds.apply_threshold_policy(df).collect()}
    assert {i for i, (a, b) in got.items() if a != b} == {0, 3}
    assert got[0] == (11.0, 0.0) and len(got) == 10
    copied = thresholds.apply_threshold_policy(df.drop("probability")).collect()
    assert all(r.prediction == r.adjusted_prediction for r in copied)


def test_sweep_matches_brute_force(spark):
    rows = [(float(l), float(p), s / 20) for l in (0, 2, 11) for p in (0, 2, 11) for s in range(20)]
    df = spark.createDataFrame(rows, "label_idx double, prediction double, score double")
    sweep = {(r.tau_infiltration, r.tau_brute_force_web): r for r in thresholds.threshold_sweep(df, "score").collect()}
    assert len(sweep) == 81
    for (a, b), r in sweep.items():
        fp = sum(1 for l, p, s in rows if l == 0 and not (p == 0 or (p == 11 and s < a) or (p == 2 and s < b)))
        tp = sum(1 for l, p, s in rows if l != 0 and not (p == 0 or (p == 11 and s < a) or (p == 2 and s < b)))
        assert (r.false_positives_alarms, r.true_positives_detected) == (fp, tp)
    best = thresholds.select_thresholds(thresholds.threshold_sweep(df, "score"), 0.5).first()
    eligible = [r for r in sweep.values() if r.true_positives_detected / r.attack_total >= 0.5]
    assert best.false_positives_alarms == min(r.false_positives_alarms for r in eligible)
    assert best.eligible_candidates_count == len(eligible)
    none = thresholds.select_thresholds(thresholds.threshold_sweep(df, "score"), 2.0).first()
    assert none.eligible_candidates_count == 0 and none.tau_infiltration is None


def test_policy_comparison(spark):
    df = spark.createDataFrame([(0.0, 11.0, 0.2)] * 5 + [(0.0, 0.0, 0.9)] * 5 + [(11.0, 11.0, 0.9)] * 5,
                               "label_idx double, prediction double, score double")
    cells = thresholds.policy_cells(thresholds.apply_score_policy(df, "score"))
    r = thresholds.policy_comparison(cells).first()
    assert (r.baseline_false_positives_alarms, r.policy_false_positives_alarms, r.false_alarm_reduction_pct) == (5, 0, 100.0)
    assert r.meets_attack_recall_target
    classes = {x.class_index: x for x in thresholds.policy_class_comparison(cells).collect()}
    assert classes[0].base_recall == 0.5 and classes[0].policy_recall == 1.0


def test_contingency_reduces_before_the_shuffle(spark):
    df = pairs(spark, [(0, 0, 1)])
    plan = evaluate.contingency(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def jobs_started(spark, build):
    """Result of a function and the number of Spark jobs that ran inside it."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        result = build()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def auc_by_force(rows):
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    pairs = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    return pairs / (len(pos) * len(neg)) if pos and neg else None


def test_rank_sum_auc_by_force(spark):
    rng = random.Random(4)
    scores = [lambda: rng.random(), lambda: round(rng.random(), 2), lambda: 0.5 + rng.random() / 2**26, lambda: rng.uniform(-3, 4), lambda: 1.0]
    rows = [(g, rng.random() < 0.3, scores[g % 5]()) for g in range(5) for _ in range(300)]
    rows += [(5, True, 0.5), (5, True, 0.7), (6, False, 0.1)] + [(0, True, None), (0, False, float("nan")), (0, None, 0.3)]
    df = spark.createDataFrame(rows, "g int, positive boolean, s double").repartition(7)
    found, jobs = jobs_started(spark, lambda: evaluate.rank_sum_auc(df, "s", F.col("positive"), ["g"]))
    assert jobs == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "partial_count" in plan, plan
    usable = [r for r in rows if None not in r and r[2] == r[2]]
    got = {r.g: r.auc for r in found.collect()}
    for g in range(7):
        want = auc_by_force([r[1:] for r in usable if r[0] == g])
        assert got[g] == (want if want is None else pytest.approx(want, abs=1e-12)), g
    whole = evaluate.rank_sum_auc(df, "s", F.col("positive")).first()
    assert whole.auc == pytest.approx(auc_by_force([r[1:] for r in usable]), abs=1e-12)


def test_evaluator_metrics_equal_mllib(spark):
    rng = random.Random(9)
    rows = [(float(rng.choice([0, 0, 0, 2, 5])), float(rng.choice([0, 2, 7]))) for _ in range(500)]
    df = spark.createDataFrame(rows, "label_idx double, prediction double")
    found, jobs = jobs_started(spark, lambda: evaluate.evaluator_metrics(df))
    assert jobs == 0
    row = found.first()
    evaluator = MulticlassClassificationEvaluator(labelCol="label_idx", predictionCol="prediction")
    for name, metric in (("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"), ("weighted_recall", "weightedRecall"),
                         ("weighted_f1", "f1")):
        assert row[name] == pytest.approx(evaluator.setMetricName(metric).evaluate(df), abs=1e-12)
    assert evaluate.evaluator_metrics(df.where("false")).first().accuracy is None


def test_score_of_the_predicted_class(spark):
    schema = T.StructType([T.StructField("prediction", T.DoubleType()), T.StructField("probability", VectorUDT())])
    df = spark.createDataFrame([(11.0, vector(11, 0.6)), (0.0, vector(0, 0.3)), (11.0, None), (3.0, Vectors.dense([0.5])),
                                (-1.0, vector(0, 0.3)), (2.0, vector(2, float("nan")))], schema)
    got = [r[0] for r in df.select(thresholds.predicted_score(df)).collect()]
    assert got == [0.6, 0.3, None, None, None, None]


def test_study_searches_validation_and_judges_test(spark):
    """The rule comes from validation rows alone; the comparison is that rule on the test rows, by force."""
    rng = random.Random(2)
    rows = [(s, float(rng.choice([0, 0, 2, 11])), float(rng.choice([0, 2, 11, 11])), rng.random()) for s in ("val", "test", "train") for _ in range(400)]
    df = spark.createDataFrame(rows, "split string, label_idx double, prediction double, score double")
    counts = thresholds.level_counts(df, F.col("score"), by=["split"])
    study, jobs = jobs_started(spark, lambda: thresholds.threshold_study(counts, 0.5))
    assert jobs == 0
    val = thresholds.select_thresholds(thresholds.threshold_sweep(df.where("split = 'val'"), "score"), 0.5).first()
    best = study["selection"].first()
    assert best == val
    taus = {11: best.tau_infiltration, 2: best.tau_brute_force_web}
    adjusted = thresholds.apply_score_policy(df.where("split = 'test'"), "score", taus)
    want = thresholds.policy_comparison(thresholds.policy_cells(adjusted), 0.5)
    assert study["comparison"].first() == want.first()
    assert study["classes"].exceptAll(thresholds.policy_class_comparison(thresholds.policy_cells(adjusted))).isEmpty()
    hopeless = thresholds.threshold_study(counts, 2.0)["comparison"].first()
    assert hopeless.false_alarms_removed == 0 and hopeless.policy_macro_f1 == hopeless.baseline_macro_f1


def test_matrix_document_round_trip(spark):
    cells = evaluate.contingency(pairs(spark, [(0, 0, 3), (0, 1, 1), (13, 2, 4)]).withColumn("split", F.lit("val")), by=["split"])
    document = evaluate.matrix_document(cells)
    assert document.first().test_metrics is None
    back = results.confusion_rows_from_matrix(document, "validation_metrics")
    dense = evaluate.dense_matrix(cells, ["split"])
    shared = ["split", "true_idx", "pred_idx", "true_label", "predicted_label", "raw_count", "true_class_support", "normalized_ratio"]
    assert back.count() == 196 and back.select(shared).exceptAll(dense.select(shared)).isEmpty()
