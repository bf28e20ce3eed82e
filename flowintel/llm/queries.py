"""The registered queries of the operators over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel.llm import (
    curriculum, debruijn, hard_negatives, kneser_ney, licenses, merkle, order_minhash, packing, parity, personal_data, quality,
    secret_scan, simhash)
from flowintel.llm.oracles import ORACLES  # noqa: F401
from flowintel.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn: Callable[[DataFrame], DataFrame], table: str = "documents") -> Callable[[DataFrame], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@_query
def op1_order_minhash(docs: DataFrame) -> DataFrame:
    return order_minhash.edited_pairs(docs)


@_query
def op2_parity_join(docs: DataFrame) -> DataFrame:
    return parity.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


@_query
def op3_personal_data(docs: DataFrame) -> DataFrame:
    return personal_data.find_personal_data(docs)


@_query
def op4_curriculum_mix(docs: DataFrame) -> DataFrame:
    return curriculum.curriculum_mix(docs).select(
        "doc_id", "size", "source_size", "target", "taken", "position", "repeat_position")


@_query
def op5_quality_divergence(docs: DataFrame) -> DataFrame:
    return quality.judge(docs, ["doc_id"])


@_query
def op6_secret_index(docs: DataFrame) -> DataFrame:
    return secret_scan.find_secrets(docs)


@_query
def op7_kneser_ney(docs: DataFrame) -> DataFrame:
    model = kneser_ney.train(docs.where(~kneser_ney.held_out("doc_id")))
    return kneser_ney.score(docs.withColumn("held_out", kneser_ney.held_out("doc_id")), model, ["doc_id", "held_out"])


@_query
def op8_best_fit_packing(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs)


@_query
def op9_debruijn_dedup(docs: DataFrame) -> DataFrame:
    return debruijn.without_repeats(docs).drop("kept")


@_query
def op10_license_scan(docs: DataFrame) -> DataFrame:
    return licenses.scan_licenses(licenses.document_paths(docs), F.col("path").rlike("/LICENSE[^/]*$"))


@_query
def op11_simhash_trie(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs)


@_query
def op12_merkle_manifest(docs: DataFrame) -> DataFrame:
    return merkle.verified_documents(docs)


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    return hard_negatives.hard_negatives(embeddings)


_query(op13_hard_negatives, "embeddings")
