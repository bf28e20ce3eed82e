"""Class balance and class-by-date distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.display import day_label
from flowintel.functions.numeric import percent, ratio


def flow_cells(
    df: DataFrame, audited: list[str], label_col: str = "label", date_col: str = "event_date", port_col: str = "dst_port",
) -> DataFrame:
    """Rows per (label, date, port) with the null or NaN counts of the audited columns, from one scan.

    Every distribution by label, date or port, and the integrity check, is a sum over these cells (pass
    weight="flow_count").  There are at most classes x dates x ports of them, whatever the number of flows.
    """
    return df.groupBy(label_col, date_col, port_col).agg(
        F.count("*").alias("flow_count"),
        *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}_null_or_nan") for c in audited])


def rows_in(weight: str | None) -> Column:
    """Number of rows, or the sum of a column that says how many rows each row stands for."""
    return F.sum(weight) if weight else F.count("*")


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per class, largest first."""
    return df.groupBy(label_col).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label_col)


def class_distribution(
    df: DataFrame, label_col: str = "label", reference_label: str = dims.BENIGN, weight: str | None = None,
) -> DataFrame:
    """Support, share, ratio to the reference class and rarity flags per class.

    Totals come from a window over the counts (one row per class), not from a second scan.
    """
    counts = df.groupBy(F.col(label_col).alias("class_name")).agg(rows_in(weight).alias("support"))
    everything = Window.partitionBy()
    reference = F.sum(F.when(F.col("class_name") == reference_label, F.col("support")).otherwise(0)).over(everything)
    return counts.select(
        "class_name",
        "support",
        percent(F.col("support"), F.sum("support").over(everything), 4).alias("percentage"),
        F.round(ratio(reference, F.col("support")), 2).alias("ratio_to_benign"),
        (F.col("support") < dims.RARE_SUPPORT).alias("is_rare_class"),
        (F.col("support") < dims.ULTRA_RARE_SUPPORT).alias("is_ultra_rare"),
    ).orderBy(F.desc("support"), "class_name")


def imbalance(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Share and ratio of the largest class to each class."""
    counts = df.groupBy(label_col).agg(F.count("*").alias("count"))
    everything = Window.partitionBy()
    return counts.select(
        label_col,
        "count",
        (ratio(F.col("count"), F.sum("count").over(everything)) * 100).alias("percentage"),
        F.round(ratio(F.max("count").over(everything), F.col("count")), 1).alias("imbalance_ratio"),
    ).orderBy(F.desc("count"), label_col)


def label_date_counts(
    df: DataFrame, label_col: str = "label", date_col: str = "event_date", weight: str | None = None,
) -> DataFrame:
    return df.groupBy(
        F.col(label_col).alias("class_name"), F.col(date_col).cast("date").alias("event_date")
    ).agg(rows_in(weight).alias("flow_count"))


def date_totals(
    df: DataFrame, label_col: str = "label", date_col: str = "event_date", weight: str | None = None,
) -> DataFrame:
    """Chronological totals per date with the axis label and the horizon (number of dates)."""
    totals = df.groupBy(F.col(date_col).cast("date").alias("event_date")).agg(rows_in(weight).alias("total_flows"))
    return totals.select(
        "event_date",
        "total_flows",
        day_label(F.col("event_date")).alias("day_label"),
        F.count("*").over(Window.partitionBy()).alias("horizon_days"),
    ).orderBy("event_date")


def temporal_profile(
    df: DataFrame, label_col: str = "label", date_col: str = "event_date", baseline: str = dims.BENIGN,
    weight: str | None = None,
) -> DataFrame:
    """Active days, primary date and daily counts per class.  Ties go to the earliest date."""
    cells = label_date_counts(df, label_col, date_col, weight)
    busiest = F.max_by(
        F.struct("event_date", "flow_count"),
        F.struct("flow_count", (-F.unix_date("event_date")).alias("earlier")),
    )
    per_class = cells.groupBy("class_name").agg(
        F.count("*").alias("active_days_count"),
        busiest.alias("primary"),
        F.sum("flow_count").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("event_date").cast("string").alias("day"), "flow_count")))).alias("daily_counts"),
    )
    return per_class.select(
        "class_name",
        "active_days_count",
        F.col("primary.event_date").alias("primary_event_date"),
        F.col("primary.flow_count").alias("primary_day_count"),
        percent(F.col("primary.flow_count"), F.col("total"), 2).alias("primary_day_percentage"),
        ((F.col("active_days_count") == 1) & (F.col("class_name") != baseline)).alias("is_single_day_attack"),
        "daily_counts",
    )


def date_label_pivot(
    df: DataFrame, labels: list[str] | None = None, label_col: str = "label", date_col: str = "event_date",
) -> DataFrame:
    """One row per date, one count column per label; absent combinations are 0.

    The label list is fixed up front, so Spark needs no extra job to discover it.
    """
    labels = labels or dims.CLASS_LABELS
    return (
        df.groupBy(F.col(date_col).cast("date").alias("event_date"))
        .pivot(label_col, labels)
        .agg(F.count(F.lit(1)))
        .fillna(0)
        .orderBy("event_date")
    )
