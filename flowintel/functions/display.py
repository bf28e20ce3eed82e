"""Columns that turn stored values into the labels and levels shown to analysts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowintel import dims


def display_band(band: Column, confirmed: Column) -> Column:
    withheld = ~F.coalesce(confirmed, F.lit(False)) | (band == "Insufficient Evidence")
    return F.when(withheld, "Insufficient Evidence").when(band != "", band).otherwise("Unknown")


def byte_label(size: Column) -> Column:
    """Bytes with base-1024 units and at most two decimals."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB", "TB")])
    # log2 of a bigint through its binary length is exact where a logarithm ratio is not
    power = F.least(F.floor((F.length(F.bin(size)) - 1) / 10), F.lit(4)).cast("int")
    scaled = F.floor(size / F.pow(F.lit(1024.0), power) * 100 + 0.5) / 100
    text = F.regexp_replace(F.format_string("%.2f", scaled), r"\.?0+$", "")
    return F.when(size == 0, "0 Bytes").otherwise(F.concat_ws(" ", text, F.get(units, power)))


def heat_level(pct: Column) -> Column:
    return (
        F.when(pct <= 0, "lvl-0").when(pct < 25, "lvl-25").when(pct < 50, "lvl-50")
        .when(pct < 75, "lvl-75").otherwise("lvl-100")
    )


def mapping_status_label(status: Column) -> Column:
    lowered = F.lower(status)
    return (
        F.when(lowered == "candidate", "Candidate Profile")
        .when(lowered == "unverified", "Unverified Mapping")
        .when(lowered == "verified", "Verified Attribution")
        .when(lowered == "not_applicable", "Benign Baseline")
        .otherwise(F.coalesce(F.when(status != "", status), F.lit("Unknown")))
    )


def cell_severity(is_diagonal: Column, share: Column) -> Column:
    """Band of a confusion cell: recall bands on the diagonal, error bands elsewhere."""
    recall = (
        F.when(share >= 0.95, "recall_strong").when(share >= 0.70, "recall_good")
        .when(share >= 0.30, "recall_weak").otherwise("recall_poor")
    )
    error = (
        F.when(share >= 0.20, "error_severe").when(share >= 0.05, "error_moderate")
        .when(share > 0, "error_minor").otherwise("none")
    )
    return F.when(is_diagonal, recall).otherwise(error)


def redundancy_class(near_duplicate: Column, strong: Column) -> Column:
    return (
        F.when(near_duplicate, "NEAR_DUPLICATE").when(strong, "STRONGLY_COLLINEAR").otherwise("NON_COLLINEAR")
    )


def pruning_decision(first: Column, second: Column, pruned: list[str] | None = None) -> Column:
    """Struct(is_pruned, pruned_feature, retained_feature); pruned only if exactly one side is listed."""
    pruned = dims.COLLINEAR_COLUMNS if pruned is None else pruned
    one, two = first.isin(pruned), second.isin(pruned)
    return F.struct(
        (one != two).alias("is_pruned"),
        F.when(one & ~two, first).when(two & ~one, second).alias("pruned_feature"),
        F.when(one & ~two, second).when(two & ~one, first).alias("retained_feature"),
    )


def clean_feature_name(name: Column) -> Column:
    return F.when(name == "protocol_idx", "protocol").otherwise(F.replace(name, F.lit("__imp"), F.lit("")))


def day_label(date: Column) -> Column:
    """MM/dd and short weekday."""
    return F.concat_ws(" ", F.date_format(date, "MM/dd"), F.date_format(date, "E"))
