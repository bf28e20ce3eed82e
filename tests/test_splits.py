from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowintel.operators import models, ranks, splits
from flowintel.operators.splits import TrainingConfig

BASE = datetime(2018, 2, 14, 8, 0, 0)


def stamped(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, timestamp_parsed timestamp")


def counts(tagged, label):
    return {r.split: r["count"] for r in tagged.where(F.col("label") == label).groupBy("split").count().collect()}


def test_per_class_blocks(spark):
    df = stamped(spark, [(f"{x}{i}", x, BASE + timedelta(minutes=i)) for x in ("Benign", "Bot") for i in range(10)])
    tagged = splits.split_per_class(df)
    assert counts(tagged, "Benign") == counts(tagged, "Bot") == {"train": 7, "val": 1, "test": 2}
    assert splits.overlap(tagged).isEmpty()


def test_ties_stay_together(spark):
    df = stamped(spark, [(f"{t}{r}", "Benign", BASE + timedelta(minutes=10 * t)) for t in range(3) for r in range(4)])
    tagged = splits.split_per_class(df)
    assert counts(tagged, "Benign") == {"train": 4, "val": 4, "test": 4}
    assert splits.overlap(tagged).isEmpty()


def test_few_timestamps(spark):
    t1 = BASE + timedelta(hours=1)
    df = stamped(spark, [("a", "One", BASE)] * 3 + [("b", "Two", BASE)] * 2 + [("c", "Two", t1)] * 2)
    tagged = splits.split_per_class(df)
    assert counts(tagged, "One") == {"train": 3}
    assert counts(tagged, "Two") == {"train": 2, "test": 2}
    both = splits.split_global(df)
    assert {r.timestamp_parsed: r.split for r in both.collect()} == {BASE: "train", t1: "test"}


def test_global_split_coverage(spark):
    t = [BASE + timedelta(hours=i) for i in range(4)]
    rows = [("Benign", 0, 3), ("FTP-BruteForce", 0, 2), ("Benign", 1, 2), ("FTP-BruteForce", 1, 2), ("Benign", 2, 2),
            ("DoS-Hulk", 2, 2), ("Benign", 3, 2), ("Bot", 3, 2)]
    df = stamped(spark, [("x", label, t[i]) for label, i, n in rows for _ in range(n)] + [("n", "Benign", None)])
    tagged = splits.split_global(df, 0.50, 0.25)
    found = {r.timestamp_parsed: r.split for r in tagged.select("timestamp_parsed", "split").distinct().collect()}
    assert found == {t[0]: "train", t[1]: "train", t[2]: "val", t[3]: "test"}
    cover = {r.class_name: r for r in splits.split_coverage(tagged).collect()}
    assert len(cover) == 14
    assert cover["FTP-BruteForce"].temporal_coverage == "train_only" and cover["FTP-BruteForce"].zero_test_support
    assert cover["DoS-Hulk"].temporal_coverage == "val_only" and cover["Bot"].temporal_coverage == "test_only"
    assert cover["Benign"].temporal_coverage == "full_span"
    assert cover["SQL Injection"].temporal_coverage == "zero_dataset_support"


@pytest.mark.parametrize("limit", [5, 10_000])
def test_narrowed_rank_equals_plain_rank(flows, limit):
    plain = flows.select("timestamp_parsed").distinct().withColumn(
        "want", F.dense_rank().over(Window.orderBy("timestamp_parsed")))
    ranked = splits.timestamp_ranks(flows, limit=limit).join(plain, "timestamp_parsed")
    assert ranked.where(F.col("d_rank") != F.col("want")).isEmpty()
    assert ranked.count() == plain.count()


@pytest.fixture(scope="module")
def dense_hour(spark):
    """Two labels (one null) with all stamps in one hour, most of them in one second, some repeated, some missing."""
    second = "make_timestamp(2018, 2, 14, 9, 30, 0)"
    close = spark.range(9000).selectExpr(
        "IF(id % 5 = 0, NULL, 'a') AS label", f"{second} + make_interval(0, 0, 0, 0, 0, 0, (id * 7919 % 6000) / 1000000) AS ts")
    wide = spark.range(600).selectExpr("'a' AS label", f"{second} + make_interval(0, 0, 0, 0, 0, id % 25, (id * 37 % 50)) AS ts")
    none = spark.range(3).selectExpr("'a' AS label", "CAST(NULL AS timestamp) AS ts")
    return close.unionByName(wide).unionByName(none).repartition(5).cache()


@pytest.mark.parametrize("by", [[], ["label"]])
def test_no_range_of_a_dense_hour_is_sorted_whole(dense_hour, by):
    limit = 200
    found = ranks.narrowed(ranks.distinct_values(dense_hour, "ts", by), limit)
    sizes = found.groupBy("_by", "_width", "_range").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= max(limit, ranks.WIDTHS[-1]) and sizes[1] > 5
    window = Window.partitionBy(*by).orderBy("ts")
    plain = dense_hour.where("ts IS NOT NULL").select(*by, "ts").distinct().select(
        *by, "ts", F.dense_rank().over(window).cast("bigint").alias("d_rank"), F.count("*").over(Window.partitionBy(*by)).alias("distinct_count"))
    got = splits.timestamp_ranks(dense_hour, "ts", by, limit)
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


@pytest.mark.parametrize("by", [[], ["label"]])
def test_cutoffs_of_a_dense_hour(dense_hour, by):
    """Only the ranges that hold a cut rank are followed, and the cutoffs are those of a plain sort."""
    cuts = {r[0] if by else None: (r["train_until"], r["val_until"]) for r in splits.split_cutoffs(dense_hour, "ts", by, limit=100).collect()}
    stamps = {}
    for r in dense_hour.where("ts IS NOT NULL").distinct().collect():
        stamps.setdefault(r.label if by else None, set()).add(r.ts)
    assert set(cuts) == set(stamps)
    for group, values in stamps.items():
        values, n = sorted(values), len(values)
        k1 = max(1, min(int(n * 0.70), n - 2))
        k2 = max(k1 + 1, min(int(n * (0.70 + 0.15)), n - 1))
        assert cuts[group] == (values[k1 - 1], values[k2 - 1])
    tagged = splits.split_per_class(dense_hour, ts_col="ts") if by else splits.split_global(dense_hour, ts_col="ts")
    assert splits.overlap(tagged, "ts").isEmpty() if not by else tagged.count() == dense_hour.where("ts IS NOT NULL").count()


def test_inter_day_and_hashed(spark, flows):
    df = spark.createDataFrame([(1, "2018-02-14"), (2, "2018-02-16"), (3, "2018-02-22"), (4, "2018-03-02")],
                               "id int, event_date string")
    assert [r.split for r in splits.split_inter_day(df).orderBy("id").collect()] == ["train", "train", "val", "test"]
    keys = ["label", "timestamp_parsed", "flow_duration"]
    first = splits.split_hashed(flows, keys)
    again = splits.split_hashed(flows.repartition(7), keys)
    assert first.exceptAll(again).isEmpty()
    share = first.where(F.col("split") == "train").count() / flows.count()
    assert 0.66 < share < 0.74


def test_split_dispatch_and_config():
    with pytest.raises(ValueError):
        TrainingConfig(train_ratio=0.95)
    with pytest.raises(ValueError):
        TrainingConfig(taus={11: 1.5})


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 10 + [("c",)], "label string")
    w = {r.label: r.weight for r in splits.class_weights(df).collect()}
    assert w == {"a": 0.37, "b": 3.7, "c": 37.0}
    capped = splits.class_weights(df, 5.0)
    assert {r.label: r.weight for r in capped.collect()}["c"] == 5.0
    rows = splits.add_class_weights(df, capped).groupBy("label").agg(F.max("weight").alias("w")).collect()
    assert {r.label: r.w for r in rows} == {"a": 0.37, "b": 3.7, "c": 5.0}


@pytest.mark.parametrize("keys", [None, ["label", "val"]])
def test_sampling_protects_rare_classes(spark, keys):
    df = spark.createDataFrame([("Benign", float(i)) for i in range(2000)] + [("SQL Injection", float(i)) for i in range(5)],
                               "label string, val double")
    tagged = splits.tag_sample(df, 0.1, keys=keys)
    rows = {r.label: r for r in splits.sampling_by_class(tagged).collect()}
    assert rows["SQL Injection"].post_sample_count == 5 and rows["SQL Injection"].is_protected
    assert 120 < rows["Benign"].post_sample_count < 280
    summary = splits.sampling_summary(splits.sampling_by_class(tagged), 0.1).first()
    assert summary.expected_rows_unprotected == 200 and summary.protected_classes == 1
    assert splits.subsample(df, None).count() == df.count()
    with pytest.raises(ValueError):
        splits.tag_sample(df, 0.1, strategy="other")


def test_feature_columns():
    from flowintel import dims

    columns = [*dims.COLUMN_MAPPING.values(), "raw_label", "timestamp_parsed", "event_date"]
    features = models.feature_columns(columns)
    assert len(columns) == 83 and len(features) == 63
    assert "protocol" in features and not {"dst_port", "label", "subflow_fwd_pkts"} & set(features)
    wide = models.feature_columns(columns, TrainingConfig(include_dst_port=True, prune_collinear_subflows=False))
    assert "dst_port" in wide and "subflow_fwd_pkts" in wide
    assert models.assembler_inputs(features)[-1] == "protocol_idx"
