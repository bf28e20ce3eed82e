"""Feature importances of tree ensembles as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowintel.functions.display import clean_feature_name
from flowintel.functions.numeric import ratio


def tree_importance(nodes: DataFrame, feature_order: DataFrame) -> DataFrame:
    """Gain x weighted rows per split, normalized per tree, averaged over the trees.

    `nodes` has treeID and nodeData(gain, split.featureIndex, impurityStats).  Features
    without a split get 0.
    """
    splits = nodes.where(
        (F.col("nodeData.gain") > 0) & (F.col("nodeData.split.featureIndex") >= 0)
    ).select(
        "treeID",
        F.col("nodeData.split.featureIndex").alias("training_index"),
        (F.col("nodeData.gain") * F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda s, x: s + x)).alias("g"),
    )
    per_tree = splits.groupBy("treeID", "training_index").agg(F.sum("g").alias("g"))
    shares = per_tree.select(
        "treeID", "training_index", ratio(F.col("g"), F.sum("g").over(Window.partitionBy("treeID"))).alias("share"))
    trees = splits.select(F.count_distinct("treeID")).scalar()
    mean = shares.groupBy("training_index").agg((F.sum("share") / trees).alias("importance"))
    return feature_order.join(mean, "training_index", "left").fillna(0.0, ["importance"])


def rank_importances(importances: DataFrame, digits: int = 8) -> DataFrame:
    """Rank 1 is the highest; equal values keep the training order."""
    value = F.round("importance", digits)
    order = Window.orderBy(F.desc("importance"), "training_index")
    return importances.select(
        "feature_name", clean_feature_name(F.col("feature_name")).alias("clean_feature_name"), "training_index",
        value.alias("importance"),
    ).withColumn("rank", F.row_number().over(order)).orderBy("rank")


def importance_checks(importances: DataFrame, expected_count: int, tolerance: float = 1e-6) -> DataFrame:
    """Count, finiteness, sign and sum, each with its flag, and the overall flag."""
    value = F.col("importance")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    checked = importances.agg(
        F.count("*").alias("feature_count"),
        F.count_if(bad).alias("non_finite"),
        F.count_if(value < 0).alias("negative"),
        F.round(F.sum("importance"), 8).alias("total"),
    )
    return checked.withColumn(
        "passed",
        (F.col("feature_count") == expected_count) & (F.col("non_finite") == 0) & (F.col("negative") == 0)
        & (F.abs(F.col("total") - 1.0) <= tolerance))


def compare_importances(computed: DataFrame, stored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored against computed values by feature name, with the match flag."""
    delta = F.abs(F.col("importance") - F.col("stored_importance"))
    return stored.select("feature_name", F.col("importance").alias("stored_importance")).join(
        computed.select("feature_name", "importance"), "feature_name", "left"
    ).select("*", F.coalesce(delta <= tolerance, F.lit(False)).alias("matches"))


def importance_page(ranked: DataFrame, page: int = 1, page_size: int = 10) -> DataFrame:
    """One page by rank with the text of its range; a page past the end shows the first one."""
    total = F.count("*").over(Window.partitionBy())
    pages = F.greatest(F.lit(1), F.ceil(total / page_size))
    shown = F.when(pages >= page, page).otherwise(1)
    first = (shown - 1) * page_size + 1
    last = F.least(shown * page_size, total)
    return ranked.withColumns({"first_rank": first, "last_rank": last, "total_pages": pages}).where(
        F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    ).withColumn("rank_range", F.format_string("Ranks %d-%d", "first_rank", "last_rank"))
