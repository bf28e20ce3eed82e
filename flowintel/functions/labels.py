"""Label Columns: canonical class, class index, tri-state category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel import dims


def standard_label(label: Column) -> Column:
    """Canonical label of a raw one: exact match without trimming; labels outside the table pass through unchanged."""
    renamed = [(raw, canonical) for raw, canonical in dims.LABEL_MAPPING.items() if raw != canonical]
    return reduce(lambda cases, pair: cases.when(label == pair[0], F.lit(pair[1])), renamed, F).otherwise(label)


def standardize_label(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Replace mapped raw labels by canonical ones and keep the input as `raw_label`."""
    renamed = df.withColumnRenamed(label_col, "raw_label")
    kept = [c for c in renamed.columns if c != "raw_label"]
    return renamed.select("raw_label", *kept, standard_label(F.col("raw_label")).alias(label_col))


def normalize_category(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Add canonical_label, raw_label, attack_status, is_attack, is_mapped.

    Trims first, accepts raw and canonical names.  Anything else is UNKNOWN, whose
    is_attack is null and never false.
    """
    spark = df.sparkSession
    mapping = dims.label_map(spark).select(F.col("raw_label").alias("_key"), F.col("canonical_label").alias("_canonical"))
    known = dims.classes(spark).select(F.col("class_name").alias("_key"), F.col("class_name").alias("_canonical"))
    named = mapping.join(F.broadcast(known.select("_key")), "_key", "left_anti")  # a class name stands for itself
    lookup = named.union(known)
    canonical = F.coalesce("_canonical", F.lit(dims.UNKNOWN))
    status = (
        F.when(F.col("_canonical").isNull(), dims.UNKNOWN)
        .when(F.col("_canonical") == dims.BENIGN, "BENIGN")
        .otherwise("ATTACK")
    )
    kept = [c for c in df.columns if c != "raw_label"]
    return (
        df.withColumn("_key", F.trim(F.coalesce(F.col(label_col), F.lit(""))))
        .join(F.broadcast(lookup), "_key", "left")
        .select(
            *kept,
            canonical.alias("canonical_label"),
            F.col("_key").alias("raw_label"),
            status.alias("attack_status"),
            (F.col("_canonical") != dims.BENIGN).alias("is_attack"),
            F.col("_canonical").isNotNull().alias("is_mapped"),
        )
    )


def add_label_index(df: DataFrame, label_col: str = "label", output_col: str = "label_idx") -> DataFrame:
    """Fixed class index as double; unknown or null label gives -1.0."""
    lookup = dims.classes(df.sparkSession).select(
        F.col("class_name").alias(label_col), F.col("class_index").cast("double").alias(output_col)
    )
    return df.join(F.broadcast(lookup), label_col, "left").fillna(-1.0, [output_col])


def index_to_label(index: Column) -> Column:
    """Class name of a prediction index; anything outside 0..13 is UNKNOWN."""
    names = F.array(*[F.lit(c) for c in dims.CLASS_LABELS])
    whole = index == F.floor(index)
    return F.coalesce(F.when(whole, F.get(names, index.cast("int"))), F.lit(dims.UNKNOWN))
