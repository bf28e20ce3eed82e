"""Reliability gates over validation metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.numeric import fixed_decimals


def assess_reliability(name: Column, support: Column, precision: Column, recall: Column, f1: Column) -> Column:
    """Struct(status, rationale) from validation support and precision / recall / F1."""
    quoted = F.concat(F.lit("Class '"), name, F.lit("'"))
    lowest = F.least(precision, recall, f1)
    incomplete = precision.isNull() | recall.isNull() | f1.isNull()
    metrics = F.concat(
        F.lit("precision="), fixed_decimals(precision, 3), F.lit(", recall="), fixed_decimals(recall, 3),
        F.lit(", F1="), fixed_decimals(f1, 3), F.lit("."),
    )
    meets = F.concat(F.lit("support="), support.cast("string"), F.lit(", "), metrics)

    def result(status: str, *text: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.concat(*text).alias("rationale"))

    return (
        F.when(support == 0, result(
            "NON_EVALUABLE", quoted,
            F.lit(" had 0 validation instances; model predictions cannot be verified on validation data.")))
        .when(support < dims.MIN_SUPPORT, result(
            "UNRELIABLE", F.lit("Validation support ("), support.cast("string"),
            F.lit(f") is below the required operational threshold ({dims.MIN_SUPPORT}).")))
        .when(incomplete, result("UNRELIABLE", quoted, F.lit(" has incomplete validation metrics.")))
        .when((support >= dims.HIGH_SUPPORT) & (lowest >= dims.HIGH_METRIC), result(
            "HIGH_RELIABILITY", quoted, F.lit(" meets high-reliability validation criteria: "), meets))
        .when(lowest >= dims.EVALUABLE_METRIC, result(
            "EVALUABLE", quoted, F.lit(" meets evaluable operational criteria: "), meets))
        .otherwise(result(
            "UNRELIABLE", quoted, F.lit(" validation performance is below operational threshold: "), metrics))
    )


def gating_tier(support: Column, precision: Column, recall: Column, f1: Column) -> Column:
    """Struct(tier, reason); undefined metrics are expected as 0.0."""
    lowest = F.least(precision, recall, f1)
    reasons = F.concat_ws(
        "; ",
        F.when(support < dims.MIN_SUPPORT, F.format_string(
            f"Validation support (%d) < {dims.MIN_SUPPORT}", support)),
        F.when(lowest < dims.EVALUABLE_METRIC, F.concat(
            F.lit("Validation metric below threshold (min="), fixed_decimals(lowest, 4),
            F.lit(f" < {dims.EVALUABLE_METRIC:.2f})"))),
    )

    def result(tier: str, reason: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), reason.alias("reason"))

    def passed(min_support: int, metric: float) -> Column:
        return F.lit(f"Validation support >= {min_support} and min(P,R,F1) >= {metric:.2f}")

    return (
        F.when(support == 0, result("NON_EVALUABLE", F.lit("Zero validation observations (Support = 0)")))
        .when((support >= dims.HIGH_SUPPORT) & (lowest >= dims.HIGH_METRIC),
              result("HIGH_RELIABILITY", passed(dims.HIGH_SUPPORT, dims.HIGH_METRIC)))
        .when((support >= dims.MIN_SUPPORT) & (lowest >= dims.EVALUABLE_METRIC),
              result("EVALUABLE", passed(dims.MIN_SUPPORT, dims.EVALUABLE_METRIC)))
        .otherwise(result("UNRELIABLE", reasons))
    )


def generalization(val_f1: Column, test_f1: Column) -> Column:
    """Text comparing validation and test F1; a gap of exactly .05 counts as a drop."""
    delta = test_f1 - val_f1
    shown = fixed_decimals(delta * 100, 1)
    return (
        F.when(F.abs(delta) < 0.05, "Consistent generalization across validation and test splits")
        .when(delta > 0.05, F.concat(F.lit("Higher test generalization (+"), shown, F.lit("%)")))
        .otherwise(F.concat(F.lit("Generalization drop on test split ("), shown, F.lit("%)")))
    )


def resolve_tier(own: Column, is_attack: Column, label: Column, has_diagnostics: Column, tier: Column) -> Column:
    """Tier shown for a profile: its own value, else baseline, unavailable, matched or unmatched."""
    return (
        F.when(own != "", own)
        .when(~F.coalesce(is_attack, F.lit(False)) | (label == dims.BENIGN), "BASELINE")
        .when(~has_diagnostics, "UNAVAILABLE")
        .otherwise(F.coalesce(F.when(tier != "", tier), F.lit("UNMATCHED")))
    )
