"""Traffic statistics per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.functions.numeric import percent


# column -> statistics and their result names
STATISTICS = {
    "flow_duration": {"avg": "duration_mean", "stddev_samp": "duration_std", "min": "duration_min", "max": "duration_max"},
    "flow_pkts_s": {"avg": "pkts_per_sec_mean", "stddev_samp": "pkts_per_sec_std", "max": "pkts_per_sec_max"},
    "flow_byts_s": {"avg": "bytes_per_sec_mean", "stddev_samp": "bytes_per_sec_std", "max": "bytes_per_sec_max"},
    "tot_fwd_pkts": {"avg": "fwd_pkts_mean", "stddev_samp": "fwd_pkts_std"},
    "tot_bwd_pkts": {"avg": "bwd_pkts_mean", "stddev_samp": "bwd_pkts_std"},
    "down_up_ratio": {"avg": "down_up_ratio_mean"},
    "totlen_fwd_pkts": {"avg": "fwd_bytes_mean"},
    "totlen_bwd_pkts": {"avg": "bwd_bytes_mean"},
    "pkt_size_avg": {"avg": "pkt_size_avg_mean"},
}


def traffic_statistics(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Duration, rate, packet and byte statistics per class, from one aggregation.

    Null statistics (no value, or the spread of a single row) are reported as 0.
    """
    rows = F.count("*")
    zero_duration = F.count_if(F.col("flow_duration") == 0)
    zero_backward = F.count_if(F.col("tot_bwd_pkts") == 0)
    return df.groupBy(F.col(label_col).alias("class_name")).agg(
        rows.alias("flow_count"),
        zero_duration.alias("zero_duration_flows"),
        percent(zero_duration, rows, 3).alias("zero_duration_pct"),
        zero_backward.alias("unidirectional_zero_bwd_flows"),
        percent(zero_backward, rows, 3).alias("unidirectional_pct"),
        *[F.expr(f"round(coalesce({fn}({c}), 0.0D), 2) AS {name}")
          for c, wanted in STATISTICS.items() for fn, name in wanted.items()],
    )
