"""A bounded sample computes its wide rows once."""

from flowintel.operators import sampling


def test_a_sample_does_not_read_its_rows_again(spark, tmp_path):
    spark.range(9_000).selectExpr("IF(id % 9 = 0, NULL, 'a') AS label", "id AS v").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    kept = sampling.bottom_k(rows, 3_000, "label")
    assert kept.inputFiles() == [] and rows.inputFiles() != []
    assert sorted(r["count"] for r in kept.groupBy("label").count().collect()) == [1_000, 3_000]
