"""Large flows are stored without a shuffle of wide rows, raw text capture by capture."""

import pytest
from pyspark.sql import functions as F

import catalog
from catalog import views
from flowintel import session
from flowintel.operators import clean
from flowintel.plans import jobs
from flowintel.sources import files, tables

catalog.load()
from catalog import storage  # noqa: E402


@pytest.fixture
def lineitem(spark, tmp_path):
    """Rows with nulls and copies."""
    rows = spark.range(2_000).selectExpr(
        "id * 7 AS l_orderkey", "id % 211 AS l_partkey", "IF(id % 9 = 0, NULL, id % 10) AS l_suppkey", "cast(id % 7 AS int) AS l_linenumber",
        "IF(id % 11 = 0, NULL, cast(id % 50 AS double)) AS l_quantity", "cast(id AS double) AS l_extendedprice")
    rows.unionByName(rows.limit(300)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_many_rows_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 80, 1, 4).selectExpr("id % 40 AS id", "IF(id % 4 = 3, NULL, date_add(date'2018-02-14', cast(id % 4 AS int))) AS event_date")
    for bound, layout in ((1 << 30, {1}), (0, {4})):
        monkeypatch.setattr(tables, "REBALANCED_BYTES", bound)
        path = f"{tmp_path}/{bound}"
        tables.write_curated(rows, path, rebalance=True)
        back = files.read_curated(spark, path)
        assert back.count() == 80 and back.exceptAll(rows).isEmpty()
        found = back.select("event_date", F.input_file_name().alias("f")).groupBy("event_date").agg(F.count_distinct("f").alias("n")).collect()
        assert len(found) == 4 and {r.n for r in found} == layout


def test_many_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(session, "UNSPREAD_ROWS", 10)
    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    rows = spark.range(0, 6000, 1, 1)
    dealt = session.spread(rows)
    assert dealt.rdd.getNumPartitions() == 60 and dealt.exceptAll(rows).isEmpty() and dealt.count() == 6000


def test_shares_are_all_rows(spark, lineitem):
    whole = views.raw_flows(spark, lineitem)
    shares = [views.raw_flows(spark, lineitem, share=(i, 3)) for i in range(3)]
    joined = shares[0].unionByName(shares[1]).unionByName(shares[2])
    assert joined.count() == 2_300 and joined.exceptAll(whole).isEmpty() and all(500 < s.count() < 1_100 for s in shares)


def test_cleaning_job_takes_capture_by_capture(spark, lineitem, monkeypatch):
    wanted = clean.cleaning_metrics(views.raw_flows(spark, lineitem)).first().asDict()
    read, kept, run = [], [], jobs.run_cleaning

    def spied(spark, raw_dir, output, **options):
        report = run(spark, raw_dir, output, **options)
        read.append(spark.read.option("header", True).csv(raw_dir).count())
        kept.append(files.read_curated(spark, output).count())
        return report

    monkeypatch.setattr(jobs, "run_cleaning", spied)
    monkeypatch.setattr(storage, "CAPTURE_ROWS", 800)
    assert storage.cleaning_job(spark, lineitem).first().asDict() == wanted
    assert len(read) == 3 and sum(read) == 2_300 and kept == sorted(kept) and kept[-1] == wanted["retained_rows"]
