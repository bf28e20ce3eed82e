"""Small results are exchanged by few tasks, however many shuffle partitions the session has."""

import pytest
from pyspark.sql import functions as F

from flowintel import session
from flowintel.llm import components, parity


@pytest.fixture
def many_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_of_few_links_take_few_tasks(many_partitions):
    links = many_partitions.range(300).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b")).repartition(40)
    found = components.components(links)
    assert found.rdd.getNumPartitions() == 1
    assert found.count() == 303 and found.where("root <> node % 3").isEmpty()


def test_compared_pairs_are_read_by_few_tasks(many_partitions):
    sets = many_partitions.range(200).selectExpr("id AS set_id", "transform(sequence(0, 9), x -> x + id) AS tokens", "array(0L) AS sketch")
    pairs = sets.selectExpr("set_id AS a", "set_id + 1 AS b").where("b < 200").repartition(40)
    found = parity.compare(pairs, sets, 80)
    assert found.rdd.getNumPartitions() <= 2
    assert found.count() == 199 and found.where("linked").count() == 199


def test_results_keep_a_task_per_share_of_rows(many_partitions, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    rows = many_partitions.range(0, 950, 1, 40)
    assert session.compacted(rows).rdd.getNumPartitions() == 10
    assert session.compacted(rows).distinct().count() == 950
