"""Evaluation of predictions from one contingency table.

Everything after `contingency` works on at most 14 x 14 counts per group, so one
aggregation over the predictions feeds all metrics.  `by` names extra group columns
(part, rule, model).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.display import cell_severity
from flowintel.functions.numeric import ratio
from flowintel.functions.reliability import gating_tier, generalization
from flowintel.operators.distribution import rows_in

_CLASS_NAMES = "array(" + ", ".join(f"'{c}'" for c in dims.CLASS_LABELS) + ")"


def _rounded(num: Column, den: Column) -> Column:
    return F.round(ratio(num, den), 4)


def _f1(p: Column, r: Column) -> Column:
    return F.try_divide(2 * p * r, p + r)


def contingency(
    df: DataFrame, label_col: str = "label_idx", prediction_col: str = "prediction", by: list[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """true_idx, pred_idx, n for indices inside the class range; other rows are left out.

    A row counts once, or as often as its `weight` column says.
    """
    inside = F.col(label_col).between(0, dims.NUM_CLASSES - 1) & F.col(prediction_col).between(0, dims.NUM_CLASSES - 1)
    return df.where(inside).groupBy(
        *(by or []), F.col(label_col).cast("int").alias("true_idx"), F.col(prediction_col).cast("int").alias("pred_idx")
    ).agg(rows_in(weight).alias("n"))


def outside_matrix(df: DataFrame, label_col: str = "label_idx", prediction_col: str = "prediction") -> DataFrame:
    """Rows that the matrix does not count."""
    top = dims.NUM_CLASSES - 1
    bad_label = ~F.coalesce(F.col(label_col).between(0, top), F.lit(False))
    bad_prediction = ~F.coalesce(F.col(prediction_col).between(0, top), F.lit(False))
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(bad_label).alias("label_outside"),
        F.count_if(bad_prediction).alias("prediction_outside"),
        F.count_if(bad_label | bad_prediction).alias("rows_outside"))


def _per_class(cells: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and class, absent classes included, with the group's cells as an array.

    A group has at most 14 x 14 cells.  Carrying them along keeps the metrics a single
    pass over the predictions, where a join with the class list would read them again.
    """
    grouped = cells.groupBy(*by).agg(F.collect_list(F.struct("true_idx", "pred_idx", "n")).alias("_cells"))
    return grouped.selectExpr(*by, "_cells", f"posexplode({_CLASS_NAMES}) AS (class_index, class_name)")


def _cell_sum(condition: str) -> str:
    """SQL text: rows in the carried cells `c` that meet the condition."""
    return f"aggregate(filter(_cells, c -> {condition}), 0L, (total, c) -> total + c.n)"


def class_support(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, true and predicted support per class, absent classes included."""
    by = by or []
    return _per_class(cells, by).selectExpr(
        *by, "class_index", "class_name",
        f"{_cell_sum('c.true_idx = class_index')} AS true_support",
        f"{_cell_sum('c.pred_idx = class_index')} AS predicted_support",
        f"{_cell_sum('c.true_idx = class_index AND c.pred_idx = class_index')} AS true_positives",
    )


def class_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 per class; null where undefined.

    F1 uses the rounded precision and recall, and is 0 for a class with rows but no hits.
    """
    support = class_support(cells, by)
    scored = support.select(
        "*",
        _rounded(F.col("true_positives"), F.col("predicted_support")).alias("precision"),
        _rounded(F.col("true_positives"), F.col("true_support")).alias("recall"),
    )
    f1 = F.round(_f1(F.col("precision"), F.col("recall")), 4)
    return scored.select(
        "*",
        F.coalesce(f1, F.when(F.col("true_support") > 0, 0.0)).alias("f1_score"),
        (F.col("true_support") == 0).alias("zero_test_support"),
        (F.col("predicted_support") == 0).alias("zero_predictions"),
    )


def _overall_aggregates() -> list[Column]:
    # the averaged values have 4 decimals; exact decimal sums make the result independent of row order
    def exact(name: str) -> str:
        return f"cast(coalesce({name}, 0) AS decimal(10,4))"

    def mean(total: str, rows: str) -> str:
        return f"coalesce(double(round({total} / nullif({rows}, 0), 4)), 0.0D)"

    def macro(name: str) -> str:
        return mean(f"sum(IF(true_support > 0, {exact(name)}, 0))", "count_if(true_support > 0)")

    def weighted(name: str) -> str:
        return mean(f"sum({exact(name)} * true_support)", "sum(true_support)")

    def share(count: str) -> str:
        return f"coalesce(round(try_divide(double({count}), double(sum(true_support))), 4), 0.0D)"

    texts = {
        "total_evaluated_samples": "sum(true_support)",
        "overall_accuracy": share("sum(true_positives)"),
        "majority_class_baseline_accuracy": share("max(true_support)"),
        "macro_f1": macro("f1_score"),
        "weighted_f1": weighted("f1_score"),
        "weighted_precision": weighted("precision"),
        "weighted_recall": weighted("recall"),
        "balanced_accuracy": macro("recall"),
    }
    return [F.expr(f"{text} AS {name}") for name, text in texts.items()]


def _binary_aggregates() -> list[Column]:
    # with class 0 as benign, its supports and hits determine the whole 2 x 2 table
    def benign(name: str) -> str:
        return f"sum(IF(class_index = 0, {name}, 0L))"

    benign_rows, total, kept = benign("true_support"), "sum(true_support)", benign("true_positives")
    missed = f"({benign('predicted_support')} - {kept})"
    texts = {
        "benign_total": benign_rows,
        "attack_total": f"{total} - {benign_rows}",
        "true_negatives_benign": kept,
        "false_positives_alarms": f"{benign_rows} - {kept}",
        "false_negatives_missed": missed,
        "true_positives_detected": f"{total} - {benign_rows} - {missed}",
    }
    return [F.expr(f"{text} AS {name}") for name, text in texts.items()]


def _with_binary_rates(sums: DataFrame) -> DataFrame:
    fp, tp = F.col("false_positives_alarms"), F.col("true_positives_detected")

    def share(num: Column, den: Column) -> Column:
        return F.coalesce(_rounded(num, den), F.lit(0.0))

    rates = sums.select(
        "*",
        share(fp, F.col("benign_total")).alias("false_alarm_rate"),
        share(F.col("true_negatives_benign"), F.col("benign_total")).alias("benign_recall"),
        share(tp, F.col("attack_total")).alias("attack_detection_rate"),
        share(tp, tp + fp).alias("attack_precision"),
    )
    f1 = F.round(_f1(F.col("attack_precision"), F.col("attack_detection_rate")), 4)
    return rates.withColumn("attack_f1_score", F.coalesce(f1, F.lit(0.0)))


def overall_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, majority baseline, macro and weighted averages over classes with support.

    `metrics` is the result of `class_metrics` with the same `by`.
    """
    return metrics.groupBy(*(by or [])).agg(*_overall_aggregates())


def binary_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Class 0 against all others from class metrics; undefined ratios are 0."""
    return _with_binary_rates(metrics.groupBy(*(by or [])).agg(*_binary_aggregates()))


def summary_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overall and binary metrics together, from one aggregation."""
    return _with_binary_rates(metrics.groupBy(*(by or [])).agg(*_overall_aggregates(), *_binary_aggregates()))


def dense_matrix(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All 14 x 14 cells with the row share (4 decimals, 0 without support) and its display band."""
    by = by or []
    rows = _per_class(cells, by).selectExpr(
        *by, "class_index AS true_idx", "class_name AS true_label", "_cells",
        f"{_cell_sum('c.true_idx = class_index')} AS true_class_support",
        f"posexplode({_CLASS_NAMES}) AS (pred_idx, predicted_label)")
    counted = rows.selectExpr(
        *by, "true_idx", "pred_idx", "true_label", "predicted_label",
        f"{_cell_sum('c.true_idx = true_idx AND c.pred_idx = pred_idx')} AS raw_count", "true_class_support")
    share = F.coalesce(_rounded(F.col("raw_count"), F.col("true_class_support")), F.lit(0.0))
    return counted.withColumn("normalized_ratio", share).withColumn(
        "severity", cell_severity(F.col("true_idx") == F.col("pred_idx"), F.col("normalized_ratio")))


def one_vs_rest_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp/fp/fn/tn and rates per class; undefined rates are 0."""
    by = by or []
    support = class_support(cells, by)
    total = F.sum("true_support").over(Window.partitionBy(*by))
    counts = support.select(
        *by, "class_index", "class_name",
        F.col("true_support").alias("support"), "predicted_support",
        F.col("true_positives").alias("tp"),
        (F.col("predicted_support") - F.col("true_positives")).alias("fp"),
        (F.col("true_support") - F.col("true_positives")).alias("fn"),
        (total - F.col("predicted_support") - F.col("true_support") + F.col("true_positives")).alias("tn"),
    )

    def rate(num: str, other: str) -> str:
        return f"coalesce(try_divide(double({num}), double({num} + {other})), 0.0D)"

    rated = counts.selectExpr("*", f"{rate('tp', 'fp')} AS _p", f"{rate('tp', 'fn')} AS _r")
    return rated.selectExpr(
        *counts.columns, "round(_p, 4) AS precision", "round(_r, 4) AS recall",
        "round(coalesce(try_divide(2 * _p * _r, _p + _r), 0.0D), 4) AS f1_score",
        f"round({rate('tn', 'fp')}, 4) AS specificity", f"round({rate('fp', 'tn')}, 4) AS fpr",
        f"round({rate('fn', 'tp')}, 4) AS fnr")


def macro_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unrounded macro averages over all 14 classes (undefined = 0), threat recall, benign FPR."""
    by = by or []
    precision = F.coalesce(ratio(F.col("true_positives"), F.col("predicted_support")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("true_positives"), F.col("true_support")), F.lit(0.0))
    sums = class_support(cells, by).groupBy(*by).agg(
        F.avg(precision).alias("macro_precision_all"),
        F.avg(recall).alias("macro_recall_all"),
        F.avg(F.coalesce(_f1(precision, recall), F.lit(0.0))).alias("macro_f1_all"),
        *_binary_aggregates(),
    )
    return sums.select(
        *by, "macro_precision_all", "macro_recall_all", "macro_f1_all",
        ratio(F.col("true_positives_detected"), F.col("attack_total")).alias("threat_recall"),
        ratio(F.col("false_positives_alarms"), F.col("benign_total")).alias("benign_fpr"))


def diagnostics(cells: DataFrame, split_col: str = "split") -> DataFrame:
    """Per class: validation and test metrics side by side, reliability tier, generalization text."""
    shown = ["support", "predicted_support", "precision", "recall", "f1_score", "specificity", "fpr", "fnr",
             "tp", "fp", "fn", "tn"]
    sides = {"val": "validation", "test": "test"}
    both = one_vs_rest_metrics(cells, [split_col]).groupBy("class_index", "class_name").agg(*[
        F.expr(f"coalesce(max(CASE WHEN {split_col} = '{split}' THEN {c} END), 0) AS {prefix}_{c}")
        for split, prefix in sides.items() for c in shown])
    gate = gating_tier(
        F.col("validation_support"), F.col("validation_precision"), F.col("validation_recall"),
        F.col("validation_f1_score"))
    return both.withColumn("_gate", gate).select(
        "class_index", "class_name",
        F.col("_gate.tier").alias("official_reliability_tier"), F.col("_gate.reason").alias("gating_reason"),
        generalization(F.col("validation_f1_score"), F.col("test_f1_score")).alias("generalization_assessment"),
        *[c for c in both.columns if c not in ("class_index", "class_name")])


def benign_false_positives(
    df: DataFrame, before: str = "prediction", after: str = "adjusted_prediction", by: list[str] | None = None,
    date_col: str = "event_date",
) -> DataFrame:
    """False alarms on benign rows per date, before and after the decision policy."""
    counters = [F.count("*").alias("total")]
    for prefix, column in (("baseline", before), ("thresh", after)):
        p = F.col(column)
        counters += [
            F.count_if(p != 0).alias(f"{prefix}_fp"),
            F.count_if(p == dims.CLASS_INDEX["Infiltration"]).alias(f"{prefix}_fp_infil"),
            F.count_if(p == dims.CLASS_INDEX["Brute Force - Web"]).alias(f"{prefix}_fp_web"),
        ]
    benign = df.where(F.col("label_idx") == 0)
    return benign.groupBy(*(by or []), F.col(date_col).cast("date").alias("event_date")).agg(*counters)


def score_histogram(
    df: DataFrame, score_col: str, class_col: str, classes: dict[str, int], bins: int = 10,
) -> DataFrame:
    """Counts per score bin over [0, 1] for the named classes; empty bins are 0, 1.0 falls in the last bin.

    Null, NaN and scores outside [0, 1] belong to no bin; `scores_outside` counts them.
    """
    slot = F.least(F.floor(F.col(score_col) * bins), F.lit(bins - 1)).cast("int")
    inside = df.where(F.col(class_col).isin(list(classes.values())) & F.col(score_col).between(0.0, 1.0))
    counts = inside.groupBy(slot.alias("bin")).agg(
        *[F.count_if(F.col(class_col) == idx).alias(f"{name}_count") for name, idx in classes.items()])
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").fillna(0).select(
        "bin", (F.col("bin") / bins).alias("bin_start"), ((F.col("bin") + 1) / bins).alias("bin_end"),
        *[f"{name}_count" for name in classes])


def scores_outside(df: DataFrame, score_col: str) -> DataFrame:
    """One row: null_scores, nan_scores, outside_scores (below 0 or above 1)."""
    score, nan = F.col(score_col), F.isnan(F.col(score_col).cast("double"))
    return df.agg(F.count_if(score.isNull()).alias("null_scores"), F.count_if(nan).alias("nan_scores"),
                  F.count_if(~nan & ~score.between(0.0, 1.0)).alias("outside_scores"))


def matrix_document(cells: DataFrame) -> DataFrame:
    """One row: validation_metrics and test_metrics, each with its confusion_matrix (class_labels, raw_matrix, normalized_matrix)."""
    dense = dense_matrix(cells, ["split"])

    def in_order(key: str, value: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])

    lines = dense.groupBy("split", "true_idx").agg(
        in_order("pred_idx", "raw_count").alias("raw"), in_order("pred_idx", "normalized_ratio").alias("normalized"))
    matrix = lines.groupBy("split").agg(F.struct(F.struct(
        F.expr(_CLASS_NAMES).alias("class_labels"), in_order("true_idx", "raw").alias("raw_matrix"),
        in_order("true_idx", "normalized").alias("normalized_matrix")).alias("confusion_matrix")).alias("_part"))
    return matrix.agg(*[F.max_by("_part", F.when(F.col("split") == split, 1)).alias(name)
                        for name, split in (("validation_metrics", "val"), ("test_metrics", "test"))])


SCORE_CELLS = 4096


def _below(parts: DataFrame, within: list[str], order: str) -> DataFrame:
    """Parts (n_pos, n_neg, _part) summed per `within`; each part's positives also pass the negatives of earlier parts."""
    earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n_neg").over(earlier), F.lit(0)).cast("decimal(19,0)")
    passed = parts.withColumn("_part", F.col("_part") + (F.col("n_pos").cast("decimal(18,0)") * below * 2).cast("decimal(38,0)"))
    return passed.groupBy(*within).agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum("_part").cast("decimal(38,0)").alias("_part"))


def rank_sum_auc(
    df: DataFrame, score_col: str, positive: Column, by: list[str] | None = None,
) -> DataFrame:
    """n_pos, n_neg and auc: the exact area under the ROC curve (per `by`), ties counted half.  Stays lazy.

    Rows are reduced to counts per distinct score.  The pairs (positive above negative) are counted as
    a rank sum in three levels: inside fine cells of the score, between those of one coarse cell, and
    between the coarse cells.  Every level passes on sums, so no window holds more than
    SCORE_CELLS rows or the distinct scores of one fine cell, and no prefix sum is joined back.
    Null and NaN scores are left out; scores outside [0, 1] fall into the first or last cell.
    """
    by = by or []
    score = F.col(score_col).cast("double")
    counts = df.where(score.isNotNull() & ~F.isnan(score) & positive.isNotNull()).groupBy(*by, score.alias("_score")).agg(
        F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"))
    inside = F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0))
    halves = (F.col("n_pos").cast("decimal(18,0)") * F.col("n_neg").cast("decimal(18,0)")).cast("decimal(38,0)")
    scores = counts.select(*by, "_score", "n_pos", "n_neg", halves.alias("_part"),
                           F.floor(inside * SCORE_CELLS).alias("_coarse"), F.floor(inside * SCORE_CELLS * SCORE_CELLS).alias("_fine"))
    fine = _below(scores, [*by, "_coarse", "_fine"], "_score")
    coarse = _below(fine, [*by, "_coarse"], "_fine")
    total = _below(coarse, by, "_coarse")
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double") * 2
    return total.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_part").cast("double"), pairs).alias("auc"))


def one_vs_benign_auc(
    df: DataFrame, score_col: str, positive_class: int, label_col: str = "label_idx", by: list[str] | None = None,
) -> DataFrame:
    """n_pos, n_neg, auc of one class against benign (no score binning)."""
    label = F.col(label_col)
    return rank_sum_auc(df.where(label.isin([0, positive_class])), score_col, label == positive_class, by)


def evaluator_metrics(
    predictions: DataFrame, label_col: str = "label_idx", prediction_col: str = "prediction", by: list[str] | None = None,
) -> DataFrame:
    """accuracy, weighted_precision, weighted_recall and weighted_f1 (per `by`) as MLlib defines them, in one lazy pass.

    Any label values are classes.  A class never predicted has precision 0, its F1 is 0; rows with a null are left out.
    """
    by = by or []
    label, prediction = F.col(label_col).cast("double"), F.col(prediction_col).cast("double")
    cells = predictions.where(label.isNotNull() & prediction.isNotNull()).groupBy(
        *by, label.alias("_t"), prediction.alias("_p")).agg(F.count("*").alias("_n"))
    sides = cells.selectExpr(*by, "inline(array(struct(_t AS c, _n AS t, 0L AS p, IF(_t = _p, _n, 0L) AS hit), struct(_p AS c, 0L AS t, _n AS p, 0L AS hit)))")
    per_class = sides.groupBy(*by, "c").agg(*[F.sum(x).alias(x) for x in ("t", "p", "hit")])
    share = "coalesce(try_divide(CAST(hit AS double), {}), 0.0D)"
    shares = per_class.selectExpr(*by, "t", "hit", f"{share.format('p')} AS precision", f"{share.format('(t + p) / 2D')} AS f1")
    total = F.sum("t")

    def weighted(column: str) -> Column:
        return F.try_divide(F.sum(F.col(column) * F.col("t")), total)

    hits = F.try_divide(F.sum("hit").cast("double"), total.cast("double"))
    # recall weighted by support is the share of hits
    metrics = shares.groupBy(*by) if by else shares
    return metrics.agg(hits.alias("accuracy"), weighted("precision").alias("weighted_precision"), hits.alias("weighted_recall"),
                       weighted("f1").alias("weighted_f1"))
