"""Models are fitted on all training rows unless a bound is asked for."""

from pyspark.sql import functions as F

from catalog.learning import FOREST
from flowintel.operators import models, sampling
from flowintel.operators.splits import TrainingConfig


def train_rows(spark, copies):
    """Training rows of two classes, some without a value, `copies` of each."""
    rows = spark.range(60).selectExpr(
        "IF(id % 6 = 0, 'Bot', 'Benign') AS label", "IF(id % 6 = 0, 1, 0) AS label_idx", "'train' AS split", "IF(id % 7 = 0, NULL, cast(id AS double)) AS v", "6 AS protocol")
    return rows.crossJoin(spark.range(copies).select()).unionByName(rows.limit(9).withColumn("split", F.lit("test")))


def test_fits_take_all_training_rows(spark, monkeypatch):
    def unexpected(*_, **__):
        raise AssertionError("sampled")

    monkeypatch.setattr(sampling, "bottom_k", unexpected)
    prepared = train_rows(spark, 3)
    for config in (TrainingConfig(), TrainingConfig(use_class_weights=False), FOREST):
        kept = models.fit_rows(prepared, config)
        wanted = prepared.where("split = 'train'")
        assert kept.count() == 180 and kept.select(*wanted.columns).exceptAll(wanted).isEmpty()
        assert ("weight" in kept.columns) == config.use_class_weights


def test_fit_rows_are_stored_by_column(spark):
    prepared = train_rows(spark, 2)
    kept = models.fit_rows(prepared, TrainingConfig(use_class_weights=False))
    assert kept.inputFiles() and all(f.endswith(".parquet") for f in kept.inputFiles())
    assert kept.schema.simpleString() == prepared.schema.simpleString()
    assert models.fit_rows(prepared.where("false"), TrainingConfig(use_class_weights=False)).isEmpty()
