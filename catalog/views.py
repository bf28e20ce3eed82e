"""Inputs that the registered queries share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.ctes import MANIFEST, RUN_ID
from flowintel import dims
from flowintel.functions.labels import add_label_index
from flowintel.operators import clean, profiles, splits
from flowintel.session import checkpointed, ensure_checkpoint_dir
from flowintel.sources import tables
from flowintel.sources.flowview import lineitem_flows

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
ROW_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what a job stores; discarded() removes it."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discarded(spark: SparkSession, path: str, result: DataFrame) -> DataFrame:
    """The stored result of a query, after what it was read from is removed."""
    result = checkpointed(result)
    tables.remove_path(spark, path)
    return result


def raw_flows(spark: SparkSession, sf: str, keep: list[str] | None = None, share: tuple[int, int] = (0, 1)) -> DataFrame:
    return lineitem_flows(spark, sf, keep, share)


def flows(spark: SparkSession, sf: str, keep: list[str] | None = None) -> DataFrame:
    return clean.clean_flows(raw_flows(spark, sf, keep))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with class index, day split and a deterministic pseudo-prediction with its score."""
    indexed = splits.split_inter_day(add_label_index(flows(spark, sf, ROW_KEYS)))
    agrees = (F.col("l_partkey") * 3 + F.col("l_orderkey")) % 10 < 7
    shifted = ((F.col("label_idx").cast("bigint") + 11) % dims.NUM_CLASSES).cast("double")
    return indexed.withColumns({
        "prediction": F.when(agrees, F.col("label_idx")).otherwise(shifted),
        "score": ((F.col("l_orderkey") * 17 + F.col("l_partkey")) % 1000).cast("double") / 1000,
    })


def campaign_profiles(spark: SparkSession, sf: str, window_type: str = "full_campaign") -> DataFrame:
    aggregates = profiles.flow_aggregates(flows(spark, sf), window_type)
    return profiles.threat_profiles(aggregates, MANIFEST, RUN_ID)
