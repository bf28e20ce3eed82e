"""Risk score Columns: components, composite score, bands and stable identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.numeric import ratio

AVAILABLE_WEIGHT = dims.WEIGHT_SEVERITY + dims.WEIGHT_FREQUENCY + dims.WEIGHT_RECURRENCE
SCHEMA_VERSION = "1.0"


def round_half_up(x: Column) -> Column:
    """Nearest integer, ties towards +infinity (F.round differs for negative ties)."""
    return F.floor(x + 0.5)


def risk_band(score: Column) -> Column:
    return (
        F.when(score < 20, "Informational")
        .when(score < 40, "Low")
        .when(score < 60, "Medium")
        .when(score < 80, "High")
        .otherwise("Critical")
    )


def clamp_score(x: Column) -> Column:
    """Clamp to 0..100; null stays null, so missing evidence never becomes 0."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double"))))


def frequency_score(flow_count: Column, max_reference: int = dims.MAX_REFERENCE_FLOWS) -> Column:
    log_max = math.log10(max_reference) if max_reference > 1 else 6.0
    positive = F.when(flow_count > 0, flow_count)
    return F.coalesce(clamp_score(F.log10(positive.cast("double")) / log_max * 100.0), F.lit(0.0))


def recurrence_denominator(window_type: Column, custom: Column | None = None) -> Column:
    default = dims.RECURRENCE_DENOMINATORS["full_campaign"]
    chosen = F.lit(default)
    for name in ("daily", "hourly"):
        chosen = F.when(window_type == name, dims.RECURRENCE_DENOMINATORS[name]).otherwise(chosen)
    return chosen if custom is None else F.when(custom > 0, custom).otherwise(chosen)


def recurrence_score(units: Column, denominator: Column) -> Column:
    share = units.cast("double") / denominator.cast("double") * 100.0
    return F.when(units > 0, F.least(F.lit(100.0), share)).otherwise(0.0)


def _band_sql(score: str) -> str:
    return (f"CASE WHEN {score} < 20 THEN 'Informational' WHEN {score} < 40 THEN 'Low' WHEN {score} < 60 THEN 'Medium' "
            f"WHEN {score} < 80 THEN 'High' ELSE 'Critical' END")


def with_risk_score(df: DataFrame, target_impact: Column | None = None, output_col: str = "tlrs_result") -> DataFrame:
    """Add the score struct to rows with severity_prior, flow_count, active_observation_units, window_type.

    The steps are separate projections, so later ones refer to finished columns instead
    of repeating the arithmetic.
    """
    impact = F.lit(None).cast("double") if target_impact is None else clamp_score(target_impact)
    components = df.withColumns({
        "_frequency": frequency_score(F.col("flow_count")),
        "_recurrence": recurrence_score(
            F.col("active_observation_units"), recurrence_denominator(F.col("window_type"))),
        "_impact": impact,
    })
    sums = components.selectExpr(
        "*",
        f"severity_prior * {dims.WEIGHT_SEVERITY!r}D + _frequency * {dims.WEIGHT_FREQUENCY!r}D "
        f"+ _recurrence * {dims.WEIGHT_RECURRENCE!r}D AS _partial")
    scores = sums.selectExpr(
        "*", f"_partial / {AVAILABLE_WEIGHT!r}D AS _normalized",
        f"_partial + _impact * {dims.WEIGHT_TARGET_IMPACT!r}D AS _complete")
    rounded = scores.selectExpr(
        "*", "int(floor(_normalized + 0.5D)) AS _normalized_int", "int(floor(_complete + 0.5D)) AS _complete_int")
    weights = ", ".join(f"'{name}', {w!r}D" for name, w in (
        ("severity", dims.WEIGHT_SEVERITY), ("frequency", dims.WEIGHT_FREQUENCY),
        ("recurrence", dims.WEIGHT_RECURRENCE), ("target_impact", dims.WEIGHT_TARGET_IMPACT)))
    result = f"""named_struct(
        'components', named_struct('severity', severity_prior, 'frequency', _frequency,
                                   'recurrence', _recurrence, 'target_impact', _impact),
        'weights', named_struct({weights}),
        'tlrs_complete', round(_complete, 4),
        'tlrs_complete_rounded', _complete_int,
        'tlrs_partial_diagnostic', round(_partial, 4),
        'tlrs_normalized_heuristic', round(_normalized, 4),
        'tlrs_normalized_rounded', _normalized_int,
        'evidence_coverage', IF(_impact IS NOT NULL, 1.0D, {round(AVAILABLE_WEIGHT, 4)!r}D),
        'scoring_status', IF(_impact IS NOT NULL, 'complete', 'insufficient_evidence'),
        'risk_band', IF(_impact IS NOT NULL, {_band_sql('_complete_int')}, 'Insufficient Evidence'),
        'provisional_risk_band', IF(_impact IS NULL, 'DIAGNOSTIC_ONLY: ' || {_band_sql('_normalized_int')}, NULL))"""
    return rounded.selectExpr(*df.columns, f"{result} AS {output_col}")


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def profile_id(source_type: Column, category: Column, start: Column, end: Column, window_type: Column) -> Column:
    """Run-invariant natural key of a profile."""
    return short_hash(source_type, category, start, end, window_type)


def snapshot_id(profile: Column, run_id: Column, manifest_hash: Column, version: str = SCHEMA_VERSION) -> Column:
    """Run-specific key of a profile."""
    return short_hash(profile, run_id, manifest_hash, F.lit(version))


def recurrence_ratio(units: Column, denominator: Column) -> Column:
    return F.coalesce(F.round(F.when(denominator > 0, ratio(units, denominator)), 4), F.lit(0.0))


def mapping_confirmed(status: Column) -> Column:
    """Only a verified mapping is confirmed, never a candidate."""
    return F.coalesce(status == "verified", F.lit(False))


def risk_confirmed(status: Column, complete_score: Column) -> Column:
    return F.coalesce((status == "complete") & complete_score.isNotNull(), F.lit(False))


def new_run_id() -> Column:
    return F.concat(
        F.lit("run_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.lit("_"),
        F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 6),
    )
