"""Bounded samples: of every class the rows with the smallest hashes.

The bound is exact.  Rows are hashed on their key columns; a class keeps the rows below a
limit, the greatest one that leaves at most `k` of them.  Rows with equal keys have
equal hashes and stay or go together.  Which rows stay depends on their content alone: not on
partitions, order or retries.

Rows per class are counted first: classes within the bound are not hashed.  Otherwise one scan of all
columns stores the rows of the smaller classes and, of the larger ones, those with hashes up to slightly
more than k / n of their range, which hold the limit unless many rows are copies; then all hashes are
looked at.  The limit is found by narrowing: hashes are counted by their leading 16 bits; only the class's cell that holds row
number k is looked at again, and counts pass through windows of at most 65,536 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel.session import checkpointed, join_per_key

SHIFTS = (48, 32, 16, 0)


def _crossing(cells: DataFrame, k: int) -> DataFrame:
    """_class, _cell, _before of the cells (_class, _base, _cell, _n) that hold row k + 1 of their class."""
    earlier = Window.partitionBy("_class").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    return cells.withColumn("_before", before).where((F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k)).select(
        "_class", "_cell", "_before")


def hash_limits(hashed: DataFrame, k: int) -> DataFrame:
    """_class, _limit for the classes of (_class, _hash) with more than k rows: exactly the hashes below it fit.

    A row counts once, or `_m` times where there is such a column.
    """
    times = F.col("_m") if "_m" in hashed.columns else F.lit(1)
    held, limits = hashed.select("_class", "_hash", times.alias("_m"), F.lit(0).alias("_base")), None
    for shift in SHIFTS:
        cells = held.groupBy("_class", "_base", F.shiftright("_hash", shift).alias("_cell")).agg(F.sum("_m").alias("_n"))
        limits = checkpointed(_crossing(cells, k))
        if shift == 0 or limits.isEmpty():
            break
        inside = join_per_key(held.withColumn("_cell", F.shiftright("_hash", shift)).drop("_base"), limits, ["_class", "_cell"], "inner")
        held = inside.groupBy("_class", "_hash", F.col("_before").alias("_base")).agg(F.sum("_m").alias("_m"))
        if shift == SHIFTS[0]:
            held = checkpointed(held)  # one cell of 65,536; the table is not scanned again
    return limits.select("_class", F.col("_cell").alias("_limit"))


def _share(k: int) -> Column:
    """Bound of the hashes that likely hold row k + 1 of a class of `_rows` rows.

    Hashes are spread evenly, so about k of them lie below k / n of their range; the margin is eight deviations.
    """
    return (k + 8 * k ** 0.5 + 64) / F.col("_rows") * 2.0 ** 64 - 2.0 ** 63


def lowest_rows(rows: DataFrame, large: DataFrame, k: int) -> DataFrame:
    """Stored rows of (_class, _hash, ...): all of the classes that are not large (_class, _rows), the lowest hashes of the others."""
    near = join_per_key(rows, large, "_class").where(F.col("_rows").isNull() | (F.col("_hash").cast("double") < _share(k)))
    return checkpointed(near.select(*rows.columns))


def lowest_hashes(hashed: DataFrame, large: DataFrame, k: int) -> DataFrame:
    """Stored counts _class, _hash, _m of the hashes of large classes (_class, _rows) that likely hold row k + 1 of their class."""
    near = join_per_key(hashed, large, "_class", "inner").where(F.col("_hash").cast("double") < _share(k))
    return checkpointed(near.groupBy("_class", "_hash").agg(F.count("*").alias("_m")))


def bottom_k(df: DataFrame, k: int, by: str, keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """At most `k` rows of every `by` value, null included; classes with no more keep all.

    Rows are told apart by `keys` (all columns without them).  If copies of one row would exceed the
    bound, all of them stay out.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    # a struct groups and joins null classes like others
    rows = df.withColumns({"_class": F.struct(by), "_hash": F.xxhash64(F.lit(seed), *(keys or df.columns))})
    large = checkpointed(rows.groupBy("_class").agg(F.count("*").alias("_rows")).where(F.col("_rows") > k))
    if large.isEmpty():
        return df
    stored = lowest_rows(rows, large, k)
    lowest = lowest_hashes(stored.select("_class", "_hash"), large, k)
    enough = lowest.groupBy("_class").agg(F.sum("_m").alias("_held")).where(F.col("_held") > k)
    if enough.count() == large.count():
        rows, limits = stored, hash_limits(lowest, k)
    else:
        limits = hash_limits(rows.select("_class", "_hash"), k)
    kept = join_per_key(rows, limits, "_class").where(F.col("_limit").isNull() | (F.col("_hash") < F.col("_limit")))
    return kept.select(*df.columns)
