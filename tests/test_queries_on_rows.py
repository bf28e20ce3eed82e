"""Registered queries on order lines built here."""

import pytest
from pyspark.sql import functions as F

import catalog
from catalog.views import flows, predictions

catalog.load()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Folder with a `lineitem` table of 4,000 rows."""
    path = str(tmp_path_factory.mktemp("lines"))
    spark.range(4000).selectExpr(
        "id AS l_orderkey", "id * 3 % 211 AS l_partkey", "id % 10 AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber",
        "double(id % 50 + 1) AS l_quantity", "double(id % 9000) + 0.25D AS l_extendedprice",
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_sweep_and_selection_judge_rows_of_all_parts(spark, lines):
    rows = predictions(spark, lines)
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}
    known = rows.where("label_idx >= 0").agg(
        F.expr("count_if(label_idx = 0) AS benign"), F.expr("count_if(label_idx > 0) AS attack")).first()
    sweep = catalog.QUERIES["threshold_sweep"](spark, lines).collect()
    assert len(sweep) == 81
    assert {(r.benign_total, r.attack_total) for r in sweep} == {(known.benign, known.attack)}
    best = catalog.QUERIES["threshold_selection"](spark, lines).first()
    assert best.total_candidates == 81 and (best.benign_total is None or best.benign_total == known.benign)


def test_wide_flows_fall_into_compiled_methods_unless_the_session_says_otherwise(spark, lines):
    key = "spark.sql.codegen.hugeMethodLimit"
    held = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        flows(spark, lines)
        assert spark.conf.get(key) == "8000"
        spark.conf.set(key, "65535")
        flows(spark, lines)
        assert spark.conf.get(key) == "65535"
    finally:
        spark.conf.set(key, held)


def test_split_differences_join_labels_without_copies(spark, lines):
    found = catalog.QUERIES["split_set_differences"](spark, lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [part for part in plan.split("\n") if "LeftSemi" in part or "LeftAnti" in part]
    assert len(joins) == 2 and plan.count("Aggregate [label") >= 4  # both sides of both joins
    parts = predictions(spark, lines).groupBy("split").agg(F.collect_set("label").alias("labels")).collect()
    labels = {r.split: set(r.labels) for r in parts}
    assert tuple(found.first()) == (len(labels["train"] & labels["test"]), len(labels["train"] - labels["val"]))
