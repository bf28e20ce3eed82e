"""One large row group is dealt out to all cores."""

import pytest
from pyspark.sql import functions as F

from flowintel import session
from flowintel.sources.flowview import lineitem_flows


@pytest.fixture
def lineitem(spark, tmp_path):
    rows = spark.range(3_000).selectExpr(
        "id AS l_orderkey", "id % 200 AS l_partkey", "IF(id % 9 = 0, NULL, id % 10) AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber",
        "cast(id % 50 AS double) AS l_quantity", "cast(id AS double) AS l_extendedprice")
    rows.unionByName(rows.limit(50)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_one_row_group_is_dealt_out(spark, lineitem, monkeypatch):
    whole = lineitem_flows(spark, lineitem)
    assert whole.select(F.spark_partition_id()).distinct().count() == 1
    monkeypatch.setattr(session, "UNSPREAD_ROWS", 1_000)
    dealt = lineitem_flows(spark, lineitem)
    assert dealt.select(F.spark_partition_id()).distinct().count() == 3 * spark.sparkContext.defaultParallelism
    assert dealt.count() == 3_050 and dealt.exceptAll(whole).isEmpty()


def test_enough_tasks_stay_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(session, "UNSPREAD_ROWS", 10)
    rows = spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism)
    assert session.spread(rows) is rows
    assert session.spread(spark.range(0)).isEmpty()


def test_uneven_tasks_are_dealt_out(spark, monkeypatch):
    """There are as many tasks as cores, but half of them hold nearly all rows."""
    monkeypatch.setattr(session, "UNSPREAD_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000 * cores, 1, cores).where(f"id < {500 * cores} OR id % 10 = 0").selectExpr("id", "IF(id % 3 = 0, NULL, 'x') AS v")
    dealt = session.spread(rows)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 * cores and max(sizes) < 2 * min(sizes)
    assert dealt.columns == rows.columns and dealt.count() == rows.count() and dealt.exceptAll(rows).isEmpty()


def test_copies_of_one_row_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(session, "UNSPREAD_ROWS", 10)
    dealt = session.spread(spark.range(0, 6000, 1, 1).selectExpr("7 AS l_orderkey"))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 3 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
