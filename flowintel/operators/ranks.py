"""Exact ranks and order statistics of distinct timestamps by repeated range narrowing.

Timestamps are counted in ranges of an hour.  A range that holds more than `limit` of them is
counted again in minutes, then seconds, then thousandths of a second, of which none holds
more than 1,000 distinct microseconds.  Every range knows how many earlier timestamps there
are, so only timestamps of one range are ever sorted together: at most `limit`, or 1,000,
however dense the capture is.  Counts of neighbouring ranges pass through windows of at
most 1,000 rows, except those of the hours themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel.session import checkpointed, join_per_key

STAMPS_PER_RANGE = 10_000
WIDTHS = (3_600_000_000, 60_000_000, 1_000_000, 1_000)  # microseconds
_KEYS = ["_by", "_width", "_range"]


def distinct_values(df: DataFrame, ts_col: str, by: list[str]) -> DataFrame:
    """Distinct timestamps per group: _by (the group as a struct), _ts, _micros."""
    group = F.struct(*by) if by else F.lit(0)
    # the null filter is stated because Spark would otherwise infer it for one of two uses only
    return df.where(F.col(ts_col).isNotNull()).select(group.alias("_by"), F.col(ts_col).alias("_ts")).distinct().withColumn(
        "_micros", F.unix_micros(F.col("_ts").cast("timestamp")))


def _counted(stamps: DataFrame, width: int, above: list[str]) -> DataFrame:
    """Ranges of one width inside those above: _by, _width, _range, _n, _before, distinct_count."""
    ranges = stamps.groupBy("_by", *above, F.floor(F.col("_micros") / width).alias("_range")).agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_by", *[c for c in above if c == "_parent"])
    earlier = F.sum("_n").over(inside.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    base = F.col("_base") if "_base" in above else F.lit(0)
    total = F.col("distinct_count") if above else F.sum("_n").over(inside)
    return ranges.select("_by", F.lit(width).alias("_width"), "_range", "_n", (base + F.coalesce(earlier, F.lit(0))).alias("_before"),
                         total.alias("distinct_count"))


def narrowed(
    stamps: DataFrame, limit: int = STAMPS_PER_RANGE, wanted: Callable[[], Column] | None = None,
) -> DataFrame:
    """Timestamps with their final range: _by, _ts, _micros, _width, _range, _n, _before, distinct_count.

    With `wanted`, a condition on _n, _before and distinct_count, only ranges that meet it are followed.
    Jobs run while the plan is built: one per width that is needed.
    """
    stamps = checkpointed(stamps)
    done, held, above = None, stamps, []
    for width in WIDTHS:
        ranges = _counted(held, width, above)
        ranges = checkpointed(ranges if wanted is None else ranges.where(wanted()))
        tagged = held.select("_by", "_ts", "_micros", F.floor(F.col("_micros") / width).alias("_range"))
        tagged = join_per_key(tagged, ranges, ["_by", "_range"], "inner")
        dense = F.col("_n") > limit
        last = width == WIDTHS[-1] or ranges.where(dense).isEmpty()
        ready = (tagged if last else tagged.where(~dense)).select(
            "_by", "_ts", "_micros", "_width", "_range", "_n", "_before", "distinct_count")
        done = ready if done is None else done.unionByName(ready)
        if last:
            break
        held = tagged.where(dense).select(
            "_by", "_ts", "_micros", F.col("_range").alias("_parent"), F.col("_before").alias("_base"), "distinct_count")
        above = ["_parent", "_base", "distinct_count"]
    return done


def ranked(df: DataFrame, ts_col: str, by: list[str], limit: int = STAMPS_PER_RANGE,
           wanted: Callable[[], Column] | None = None) -> DataFrame:
    """by, ts_col, d_rank (from 1) and distinct_count of the distinct timestamps, or of those in the wanted ranges."""
    found = narrowed(distinct_values(df, ts_col, by), limit, wanted)
    place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy("_micros"))
    return found.select(*[F.col("_by").getField(c).alias(c) for c in by], F.col("_ts").alias(ts_col),
                        (F.col("_before") + place).alias("d_rank"), "distinct_count")
