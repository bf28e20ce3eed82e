"""Bounded samples by hash: exact bounds, whole copies, the same rows in every layout."""

import pytest
from pyspark.sql import functions as F

from flowintel.operators import models, sampling, splits
from flowintel.operators.splits import TrainingConfig


@pytest.fixture(scope="module")
def rows(spark):
    """One class with most rows, small ones, a null class, and copies."""
    many = spark.range(20_000).selectExpr("IF(id % 10 < 8, 'big', IF(id % 10 = 8, NULL, 'mid')) AS label", "id AS v")
    few = spark.range(30).selectExpr("'small' AS label", "id AS v")
    copies = spark.range(500).selectExpr("'copied' AS label", "id % 5 AS v")
    return many.unionByName(few).unionByName(copies).cache()


@pytest.mark.parametrize("k", [0, 1, 30, 99, 1000, 3000])
def test_bound_is_exact(rows, k):
    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    kept = {r.label: r["count"] for r in sampling.bottom_k(rows, k, "label", ["v"]).groupBy("label").count().collect()}
    for label, n in seen.items():
        if label == "copied":  # five groups of a hundred copies
            assert kept.get(label, 0) == min(n, k // 100 * 100)
        else:
            assert kept.get(label, 0) == min(n, k)


def test_smallest_hashes_are_kept(rows):
    kept = sampling.bottom_k(rows.where("label = 'big'"), 100, "label", ["v"], seed=7)
    ordered = rows.where("label = 'big'").orderBy(F.xxhash64(F.lit(7), "v")).limit(100)
    assert kept.exceptAll(ordered).isEmpty() and kept.count() == 100


def test_sample_does_not_depend_on_the_layout(rows):
    first = sampling.bottom_k(rows, 200, "label")
    for layout in (rows.repartition(1), rows.repartition(13, "v"), rows.orderBy(F.desc("v"))):
        again = sampling.bottom_k(layout, 200, "label")
        assert first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()
    other = sampling.bottom_k(rows, 200, "label", seed=1)
    assert not first.exceptAll(other).isEmpty()


def test_odd_input(spark, rows):
    assert sampling.bottom_k(rows.where("false"), 5, "label").isEmpty()
    clashing = rows.limit(10).selectExpr("*", "1 AS n", "2 AS count")
    assert sampling.bottom_k(clashing, 3, "label").columns == clashing.columns
    with pytest.raises(ValueError):
        sampling.bottom_k(rows, -1, "label")


def test_fit_rows_are_bounded_and_weighted(flows):
    config = TrainingConfig(split_strategy="chronological_per_class", fit_rows_per_class=50)
    prepared, _ = models.prepare(flows, config)
    kept = models.fit_rows(prepared, config)
    per_class = kept.groupBy("label_idx").agg(F.count("*").alias("n"), F.count_distinct("weight").alias("weights")).collect()
    assert per_class and all(r.n <= 50 and r.weights == 1 for r in per_class)
    train = prepared.where("split = 'train'").groupBy("label_idx").count().collect()
    assert {r.label_idx for r in per_class} == {r.label_idx for r in train}
    whole = models.fit_rows(prepared, TrainingConfig(fit_rows_per_class=None, use_class_weights=False))
    assert whole.count() == sum(r["count"] for r in train)
    assert splits.class_weights(kept).count() == len(per_class)
