"""Queries on time splits make the flows once, and their cells count what the rows count."""

import pytest
from pyspark.sql import functions as F

import catalog
from catalog import QUERIES
from catalog.views import flows
from flowintel.operators import splits

catalog.load()


@pytest.fixture
def lineitem(spark, tmp_path):
    rows = spark.range(2_000).selectExpr(
        "IF(id % 97 = 0, NULL, id) AS l_orderkey", "id % 200 AS l_partkey", "IF(id % 9 = 0, NULL, id % 10) AS l_suppkey",
        "cast(id % 7 AS int) AS l_linenumber", "cast(id % 50 AS double) AS l_quantity", "cast(id AS double) AS l_extendedprice")
    rows.unionByName(rows.limit(300)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["split_global", "split_per_class", "split_overlap", "split_coverage"])
def test_flows_are_read_once(spark, lineitem, name):
    assert flows(spark, lineitem).inputFiles()
    assert QUERIES[name](spark, lineitem).inputFiles() == []  # what is returned reads stored cells


@pytest.mark.parametrize("name, split", [("split_global", splits.split_global), ("split_per_class", splits.split_per_class)])
def test_cells_count_rows(spark, lineitem, name, split):
    by_rows = split(flows(spark, lineitem)).groupBy("label", "split").agg(
        F.count("*").alias("flow_count"), *[F.date_format(f("timestamp_parsed"), "yyyy-MM-dd HH:mm:ss").alias(c)
                                            for c, f in (("first_seen", F.min), ("last_seen", F.max))])
    assert _rows(QUERIES[name](spark, lineitem)) == _rows(by_rows)


def test_coverage_and_overlap_of_cells(spark, lineitem):
    tagged = splits.split_global(flows(spark, lineitem))
    assert _rows(QUERIES["split_coverage"](spark, lineitem)) == _rows(splits.split_coverage(tagged))
    assert [tuple(r) for r in QUERIES["split_overlap"](spark, lineitem).collect()] == [(0,)]


def test_overlap_finds_a_timestamp_in_two_parts(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2018-02-14 01:00:00', 'train'), ('b', TIMESTAMP'2018-02-14 01:00:00', 'val'),"
                     " ('a', TIMESTAMP'2018-02-14 01:00:00', 'train'), (NULL, NULL, 'val') AS t(label, timestamp_parsed, split)")
    cells = splits.timestamp_cells(rows)
    assert {(r.label, r.flow_count) for r in cells.collect()} == {("a", 2), ("b", 1)}
    tagged = cells.withColumn("split", F.when(F.col("label") == "a", "train").otherwise("val"))
    assert splits.overlap(tagged).count() == 1
