"""Decision policy on class probabilities, and the search for its thresholds."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.operators.evaluate import class_metrics, contingency, summary_metrics

# Candidate thresholds of the grid search (9 x 9 rules within [0, 0.60])
GRID_STEPS = [0.0, 0.20, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60]
RECALL_TARGET = 0.95


def probability_array(df: DataFrame, probability_col: str) -> Column:
    """Probabilities as an array, empty for null; reads vectors and arrays alike."""
    empty = F.array().cast("array<double>")
    if isinstance(df.schema[probability_col].dataType, VectorUDT):
        return vector_to_array(F.coalesce(F.col(probability_col), array_to_vector(empty)))
    return F.coalesce(F.col(probability_col), empty)


def class_score(probabilities: Column, index: int) -> Column:
    """Probability of one class; null if the array is too short or the value is not a number."""
    value = F.get(probabilities, F.lit(index))
    return F.when((F.size(probabilities) >= dims.NUM_CLASSES) & ~F.isnan(value), value)


def apply_threshold_policy(
    df: DataFrame, taus: dict[int, float] | None = None, prediction_col: str = "prediction",
    probability_col: str = "probability", output_col: str = "adjusted_prediction",
) -> DataFrame:
    """Predictions of the listed classes fall back to benign strictly below their threshold.

    Rows without usable probabilities keep their prediction, the input column stays as it is.
    """
    taus = dims.TAU_BY_CLASS if taus is None else taus
    if probability_col not in df.columns or prediction_col not in df.columns:
        return df.withColumn(output_col, F.col(prediction_col))
    p = probability_array(df, probability_col)
    unsure = F.lit(False)
    for index, tau in taus.items():
        unsure = unsure | ((F.col(prediction_col) == index) & F.coalesce(class_score(p, index) < tau, F.lit(False)))
    return df.withColumn(output_col, F.when(unsure, 0.0).otherwise(F.col(prediction_col)))


def apply_score_policy(
    df: DataFrame, score_col: str, taus: dict[int, float] | None = None, prediction_col: str = "prediction",
    output_col: str = "adjusted_prediction",
) -> DataFrame:
    """Same policy where only the score of the predicted class is stored."""
    taus = dims.TAU_BY_CLASS if taus is None else taus
    score = F.col(score_col)
    unsure = F.lit(False)
    for index, tau in taus.items():
        low = score.isNotNull() & ~F.isnan(score) & (score < tau)
        unsure = unsure | ((F.col(prediction_col) == index) & low)
    return df.withColumn(output_col, F.when(unsure, 0.0).otherwise(F.col(prediction_col)))


def predicted_score(df: DataFrame, prediction_col: str = "prediction", probability_col: str = "probability") -> Column:
    """Probability of the predicted class, from the vector or array; null where there is none."""
    p = probability_array(df, probability_col)
    value = F.get(p, F.col(prediction_col).cast("int"))
    return F.when((F.size(p) >= dims.NUM_CLASSES) & (F.col(prediction_col) >= 0) & ~F.isnan(value), value)


def level_counts(
    df: DataFrame, score: Column, steps: list[float] | None = None, classes: tuple[int, int] = (11, 2),
    prediction_col: str = "prediction", label_col: str = "label_idx", by: list[str] | None = None,
) -> DataFrame:
    """by, _level, true_idx, pred_idx, n: all that any rule of the grid needs to know about the rows.

    _level is the number of thresholds not above the score, or all of them where the prediction is
    none of the two classes or the score is missing: at most 14 x 14 x 10 counts per group.
    """
    steps = steps or GRID_STEPS
    reached = sum((F.coalesce(F.col("_score") >= tau, F.lit(False)).cast("int") for tau in steps), F.lit(0))
    usable = F.col("_score").isNotNull() & ~F.isnan("_score") & F.col(prediction_col).isin(*classes)
    levels = df.withColumn("_score", score.cast("double")).withColumn("_level", F.when(usable, reached).otherwise(len(steps)))
    return contingency(levels, label_col, prediction_col, [*(by or []), "_level"])


def _is_cut(first_step: Column, second_step: Column, classes: tuple[int, int]) -> Column:
    """Whether a count falls below the thresholds with these numbers: a score reaching k of them is below number k."""
    return (F.when(F.col("pred_idx") == classes[0], first_step >= F.col("_level"))
            .when(F.col("pred_idx") == classes[1], second_step >= F.col("_level")).otherwise(False))


def sweep_counts(
    counts: DataFrame, steps: list[float] | None = None, classes: tuple[int, int] = (11, 2),
) -> DataFrame:
    """Metrics of every pair of thresholds, from level_counts()."""
    steps = steps or GRID_STEPS
    rules = ", ".join(
        f"({i * len(steps) + j}, {a!r}D, {b!r}D, {i}, {j})"
        for i, a in enumerate(steps) for j, b in enumerate(steps))
    expanded = counts.selectExpr(
        "*", f"inline(array({rules})) AS (candidate_id, tau_infiltration, tau_brute_force_web, i, j)")
    cut = _is_cut(F.col("i"), F.col("j"), classes)
    keys = ["candidate_id", "tau_infiltration", "tau_brute_force_web"]
    cells = expanded.withColumn("pred_idx", F.when(cut, 0).otherwise(F.col("pred_idx"))).groupBy(
        *keys, "true_idx", "pred_idx").agg(F.sum("n").alias("n"))
    return summary_metrics(class_metrics(cells, keys), keys).select(
        *keys, F.col("overall_accuracy").alias("accuracy"), "macro_f1", "benign_recall",
        F.col("false_alarm_rate").alias("false_positive_rate"),
        F.col("attack_detection_rate").alias("attack_recall"), "attack_precision",
        "false_positives_alarms", "true_positives_detected", "benign_total", "attack_total",
    )


def threshold_sweep(
    df: DataFrame, score_col: str, steps: list[float] | None = None,
    classes: tuple[int, int] = (11, 2), prediction_col: str = "prediction", label_col: str = "label_idx",
) -> DataFrame:
    """Metrics of every pair of thresholds.

    Rows are reduced once to counts; only these are expanded to the candidate rules, so the cost
    of the data pass does not depend on the number of rules.
    """
    return sweep_counts(level_counts(df, F.col(score_col), steps, classes, prediction_col, label_col), steps, classes)


def select_thresholds(sweep: DataFrame, recall_target: float = RECALL_TARGET) -> DataFrame:
    """Eligible rule with the lowest false-positive count.

    Ties go to more detections, then to the lower candidate number.  The comparison uses
    the exact counts, not the rounded rates.
    """
    exact_recall = F.try_divide(F.col("true_positives_detected").cast("double"), F.col("attack_total").cast("double"))
    marked = sweep.withColumn("eligible", F.coalesce(exact_recall >= recall_target, F.lit(False)))
    order = F.struct(
        F.col("false_positives_alarms"), (-F.col("true_positives_detected")).alias("missed"), F.col("candidate_id"))
    best = F.min_by(F.struct(*sweep.columns), F.when(F.col("eligible"), order))
    return marked.agg(
        F.count("*").alias("total_candidates"),
        F.count_if("eligible").alias("eligible_candidates_count"),
        F.when(F.count_if("eligible") > 0, best).alias("best"),
    ).select("total_candidates", "eligible_candidates_count", "best.*")


def policy_cells(
    df: DataFrame, before: str = "prediction", after: str = "adjusted_prediction", label_col: str = "label_idx",
    by: list[str] | None = None,
) -> DataFrame:
    """Contingency of both prediction columns as `rule` = baseline / policy, from one data pass."""
    by = by or []
    triples = df.groupBy(*by, label_col, before, after).agg(F.count("*").alias("_n"))
    variants = triples.select(*by, label_col, "_n", F.inline(F.array(
        F.struct(F.lit("baseline").alias("rule"), F.col(before).alias("_pred")),
        F.struct(F.lit("policy").alias("rule"), F.col(after).alias("_pred")))))
    top = dims.NUM_CLASSES - 1
    inside = F.col(label_col).between(0, top) & F.col("_pred").between(0, top)
    return variants.where(inside).groupBy(
        *by, "rule", F.col(label_col).cast("int").alias("true_idx"), F.col("_pred").cast("int").alias("pred_idx")
    ).agg(F.sum("_n").alias("n"))


def policy_comparison(cells: DataFrame, recall_target: float = RECALL_TARGET) -> DataFrame:
    """Metrics of both rules side by side, with deltas, false-alarm reduction and the target flag."""
    shown = ["overall_accuracy", "macro_f1", "balanced_accuracy", "benign_recall", "false_alarm_rate",
             "attack_detection_rate", "attack_precision", "attack_f1_score", "false_positives_alarms"]
    wide = summary_metrics(class_metrics(cells, ["rule"]), ["rule"]).agg(*[
        F.expr(f"max(CASE WHEN rule = '{rule}' THEN {c} END) AS {rule}_{c}")
        for rule in ("baseline", "policy") for c in shown])
    removed = F.col("baseline_false_positives_alarms") - F.col("policy_false_positives_alarms")
    return wide.select(
        "*",
        F.round(F.col("policy_overall_accuracy") - F.col("baseline_overall_accuracy"), 4).alias("accuracy_gain"),
        F.round(F.col("policy_attack_detection_rate") - F.col("baseline_attack_detection_rate"), 4)
        .alias("attack_recall_change"),
        removed.alias("false_alarms_removed"),
        F.round(F.try_divide(
            removed.cast("double"), F.col("baseline_false_positives_alarms").cast("double")) * 100, 1)
        .alias("false_alarm_reduction_pct"),
        (F.col("policy_attack_detection_rate") >= recall_target).alias("meets_attack_recall_target"),
    )


def policy_class_comparison(cells: DataFrame) -> DataFrame:
    """Per class: precision, recall and F1 of both rules."""
    metrics = class_metrics(cells, ["rule"])
    return metrics.groupBy("class_index", "class_name").agg(
        F.max("true_support").alias("support"),
        *[F.expr(f"max(CASE WHEN rule = '{rule}' THEN {c} END) AS {prefix}_{c}")
          for rule, prefix in (("baseline", "base"), ("policy", "policy"))
          for c in ("precision", "recall", "f1_score")])


def threshold_study(
    counts: DataFrame, recall_target: float = RECALL_TARGET, steps: list[float] | None = None,
    classes: tuple[int, int] = (11, 2), search: str = "val", judge: str = "test",
) -> dict[str, DataFrame]:
    """Rules searched on one part and judged on another, from level_counts() by `split`; stays lazy.

    sweep and selection read the counts of `search`.  comparison and classes put the selected rule beside the
    plain predictions on `judge`; without an eligible rule both are equal.
    """
    steps = steps or GRID_STEPS
    sweep = sweep_counts(counts.where(F.col("split") == search).drop("split"), steps, classes)
    selection = select_thresholds(sweep, recall_target)
    chosen = selection.select("candidate_id").scalar()
    cut = F.coalesce(_is_cut(F.floor(chosen / len(steps)), chosen % len(steps), classes), F.lit(False))
    judged = counts.where(F.col("split") == judge)
    cells = judged.select("true_idx", "n", F.inline(F.array(
        F.struct(F.lit("baseline").alias("rule"), F.col("pred_idx")),
        F.struct(F.lit("policy").alias("rule"), F.when(cut, 0).otherwise(F.col("pred_idx")).alias("pred_idx")))))
    cells = cells.groupBy("rule", "true_idx", "pred_idx").agg(F.sum("n").alias("n"))
    return {"sweep": sweep, "selection": selection, "comparison": policy_comparison(cells, recall_target),
            "classes": policy_class_comparison(cells)}
