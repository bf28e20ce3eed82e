"""Classes within the bound are not hashed; of larger ones only the lowest hashes are stored."""

import pytest
from pyspark.sql import functions as F

from flowintel.operators import sampling


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(30_000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 'a', 'b')) AS label", "id AS v").cache()


def test_no_limits_are_looked_for_within_the_bound(rows, monkeypatch):
    def unexpected(*_):
        raise AssertionError("hashed")

    monkeypatch.setattr(sampling, "hash_limits", unexpected)
    assert sampling.bottom_k(rows, 10_000, "label").count() == 30_000


@pytest.mark.parametrize("k", [0, 1, 500, 9_999])
def test_lowest_hashes_give_the_limits_of_all(rows, k):
    hashed = rows.select(F.struct("label").alias("_class"), F.xxhash64(F.lit(42), "v").alias("_hash"))
    large = hashed.groupBy("_class").agg(F.count("*").alias("_rows"))
    lowest = sampling.lowest_hashes(hashed, large, k)
    found, wanted = sampling.hash_limits(lowest, k), sampling.hash_limits(hashed, k)
    assert found.count() == 3 and found.exceptAll(wanted).isEmpty()
    assert lowest.count() <= 3 * (k + 16 * k ** 0.5 + 200)


def test_copies_beyond_the_bound_fall_back_to_all_hashes(spark):
    copies = spark.range(1000).selectExpr("'c' AS label", "id % 2 AS v")
    assert sampling.bottom_k(copies, 600, "label").count() == 500
    assert sampling.bottom_k(copies, 400, "label").isEmpty()
