"""Findings derived from the analytics tables, for model design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel import dims

# Finding categories
CATEGORIES = [
    "Train/Test Splitting Strategy", "Extreme Class Imbalance Handling", "Port Shortcut Learning Risk",
    "Feature Redundancy Elimination", "Unidirectional Flow Signature",
]


def observations(
    temporal: DataFrame, distribution: DataFrame, ports: DataFrame, correlations: DataFrame, traffic: DataFrame,
) -> DataFrame:
    """Five findings, each counted from its own table: category, affected, evaluated."""
    parts = [
        (temporal.where(F.col("class_name") != dims.BENIGN), F.col("is_single_day_attack")),
        (distribution, F.col("is_ultra_rare")),
        (ports, F.col("has_extreme_port_concentration")),
        (correlations, F.col("is_near_duplicate")),
        (traffic, F.col("unidirectional_zero_bwd_flows") > 0),
    ]
    result = None
    for name, (table, affected) in zip(CATEGORIES, parts):
        row = table.agg(
            F.lit(name).alias("category"), F.count_if(affected).alias("affected"), F.count("*").alias("evaluated")
        )
        result = row if result is None else result.unionByName(row)
    return result.withColumn(
        "finding", F.format_string("%d of %d evaluated entries show this trait", "affected", "evaluated"))
