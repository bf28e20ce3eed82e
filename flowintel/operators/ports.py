"""Destination-port concentration per class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.display import heat_level
from flowintel.functions.numeric import percent
from flowintel.operators.distribution import rows_in


def add_port_service(df: DataFrame, port_col: str = "port") -> DataFrame:
    """service_name with the default text for unlisted ports."""
    lookup = dims.port_services(df.sparkSession).withColumnRenamed("port", port_col)
    default = F.format_string("Custom / Unassigned (%d)", F.col(port_col))
    return (
        df.join(F.broadcast(lookup), port_col, "left")
        .withColumn("service_name", F.coalesce("known_service", default))
        .drop("known_service")
    )


def add_port_criticality(df: DataFrame, port_col: str = "port") -> DataFrame:
    """criticality_weight, 50 for unlisted ports."""
    lookup = dims.port_criticality(df.sparkSession).withColumnRenamed("port", port_col)
    return (
        df.join(F.broadcast(lookup), port_col, "left")
        .withColumn("criticality_weight", F.coalesce("known_criticality", F.lit(dims.DEFAULT_CRITICALITY)))
        .drop("known_criticality")
    )


def port_counts(
    df: DataFrame, label_col: str = "label", port_col: str = "dst_port", weight: str | None = None,
) -> DataFrame:
    """Flows per (class, port) with the class total.

    The class total is a sum over the port counts, so the data is read and shuffled once.
    """
    counts = df.groupBy(
        F.col(label_col).alias("class_name"), F.col(port_col).alias("port")
    ).agg(rows_in(weight).alias("flow_count"))
    return counts.withColumn("total_flows", F.sum("flow_count").over(Window.partitionBy("class_name")))


def top_ports(
    df: DataFrame, top_n: int = 5, label_col: str = "label", port_col: str = "dst_port", weight: str | None = None,
) -> DataFrame:
    """The top-N ports of each class with share, service and criticality; ties by port number."""
    order = Window.partitionBy("class_name").orderBy(F.desc("flow_count"), "port")
    ranked = (
        port_counts(df, label_col, port_col, weight)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
    )
    shares = ranked.withColumn("percentage_within_class", percent(F.col("flow_count"), F.col("total_flows"), 2))
    return add_port_criticality(add_port_service(shares)).select(
        "class_name", "rank", "port", "service_name", "criticality_weight", "flow_count", "total_flows",
        "percentage_within_class",
    )


def port_concentration(
    df: DataFrame, top_n: int = 5, label_col: str = "label", port_col: str = "dst_port", weight: str | None = None,
) -> DataFrame:
    """Per class: the top ports as an array, top-1 and top-3 share, extreme-concentration flag."""
    item = F.struct(
        "rank", "port", "service_name", "criticality_weight", "flow_count", "percentage_within_class"
    )
    share = F.col("percentage_within_class")
    return (
        top_ports(df, top_n, label_col, port_col, weight)
        .groupBy("class_name", "total_flows")
        .agg(
            F.array_sort(F.collect_list(item)).alias("top_ports"),
            F.round(F.max(F.when(F.col("rank") == 1, share)), 2).alias("concentration_top_1_port_pct"),
            F.round(F.sum(F.when(F.col("rank") <= 3, share)), 2).alias("concentration_top_3_ports_pct"),
        )
        .withColumn(
            "has_extreme_port_concentration", F.col("concentration_top_1_port_pct") >= dims.EXTREME_PORT_PCT)
    )


def port_matrix(
    df: DataFrame, top_n: int = 5, label_col: str = "label", port_col: str = "dst_port", weight: str | None = None,
) -> DataFrame:
    """Class x fixed-port matrix of the top-port shares; absent cells are 0.

    Each class row carries its few top ports, so a cell is looked up in that array and no join is needed.
    """
    cells = port_concentration(df, top_n, label_col, port_col, weight).select(
        "class_name", "total_flows", "top_ports",
        F.explode(F.array(*[F.lit(p) for p in dims.MATRIX_PORTS])).alias("port"),
    )
    hit = F.get(F.filter("top_ports", lambda t: t["port"] == F.col("port")), F.lit(0))
    share = F.coalesce(hit["percentage_within_class"], F.lit(0.0))
    return cells.select(
        "class_name", "total_flows", "port",
        F.coalesce(hit["flow_count"], F.lit(0)).alias("flow_count"),
        share.alias("percentage_within_class"),
        heat_level(share).alias("heat_level"),
    )
