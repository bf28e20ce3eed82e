"""Correlation of feature pairs and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.display import pruning_decision, redundancy_class


def pearson(a: str, b: str) -> Column:
    """Pearson r over rows where both values are present; null for a constant column.

    Written from population moments because the built-in raises on zero variance in ANSI mode.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def feature_correlations(df: DataFrame, pairs: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """One row per pair with r (6 decimals), flags and the recommendation.

    All pairs are computed by a single aggregation over one scan.
    """
    pairs = pairs or dims.FEATURE_PAIRS
    rows = [
        F.struct(
            F.lit(pos).alias("pair_no"), F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"),
            F.lit(text).alias("description"),
            F.round(F.coalesce(pearson(a, b), F.lit(0.0)), 6).alias("pearson_correlation"),
        )
        for pos, (a, b, text) in enumerate(pairs)
    ]
    r = F.abs("pearson_correlation")
    near = r >= dims.NEAR_DUPLICATE_R
    drop = F.concat(F.lit("Drop "), F.col("feature_2"), F.lit(" (redundant duplicate of "), F.col("feature_1"), F.lit(")"))
    return df.agg(F.array(*rows).alias("pairs")).select(F.inline("pairs")).select(
        "*",
        near.alias("is_near_duplicate"),
        (r >= dims.STRONG_R).alias("is_strongly_collinear"),
        F.when(near, drop).otherwise("Retain or monitor in tree feature importance").alias("recommendation"),
    )


def redundant_pair_count(correlations: DataFrame) -> DataFrame:
    return correlations.agg(
        F.count("*").alias("evaluated_pairs_count"),
        F.count_if(F.col("is_near_duplicate") | F.col("is_strongly_collinear")).alias("redundant_pairs_count"),
        F.count_if("is_near_duplicate").alias("near_duplicate_pairs_count"),
    )


def classify_pairs(correlations: DataFrame, wanted: str | None = None) -> DataFrame:
    """Disjoint redundancy class and pruning decision per pair, optionally one class only."""
    classified = correlations.withColumn(
        "redundancy_class", redundancy_class(F.col("is_near_duplicate"), F.col("is_strongly_collinear"))
    ).select("*", pruning_decision(F.col("feature_1"), F.col("feature_2")).alias("d"))
    shown = classified.select(*[c for c in classified.columns if c != "d"], "d.*")
    return shown if wanted is None else shown.where(F.col("redundancy_class") == wanted)
