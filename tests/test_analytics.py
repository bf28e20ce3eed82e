import pytest
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.operators import distribution, findings, ports, redundancy, traffic


def test_class_distribution(spark):
    df = spark.createDataFrame([("Benign",)] * 7 + [("Bot",)] * 2 + [("SQL Injection",)], "label string")
    rows = {r.class_name: r for r in distribution.class_distribution(df).collect()}
    assert (rows["Benign"].percentage, rows["Benign"].ratio_to_benign) == (70.0, 1.0)
    assert (rows["Bot"].percentage, rows["Bot"].ratio_to_benign) == (20.0, 3.5)
    assert rows["SQL Injection"].is_ultra_rare and rows["SQL Injection"].percentage == 10.0


def test_temporal_profile_and_tie(spark):
    df = spark.createDataFrame(
        [("Benign", "2018-02-14"), ("Benign", "2018-03-02"), ("Bot", "2018-03-02"), ("Bot", "2018-03-02")],
        "label string, event_date string")
    totals = {str(r.event_date): r.total_flows for r in distribution.date_totals(df).collect()}
    assert totals == {"2018-02-14": 1, "2018-03-02": 3}
    rows = {r.class_name: r for r in distribution.temporal_profile(df).collect()}
    bot = rows["Bot"]
    assert (bot.active_days_count, str(bot.primary_event_date), bot.primary_day_percentage) == (1, "2018-03-02", 100.0)
    assert bot.is_single_day_attack
    assert str(rows["Benign"].primary_event_date) == "2018-02-14"


def test_pivot_has_all_labels(spark):
    df = spark.createDataFrame([("Bot", "2018-03-02")], "label string, event_date string")
    row = distribution.date_label_pivot(df).first()
    assert row["Bot"] == 1 and row["Benign"] == 0 and len(row) == 15


def test_traffic_statistics(spark):
    columns = "label string, " + ", ".join(f"{c} double" for c in traffic.STATISTICS)
    order = list(traffic.STATISTICS)
    one = dict(flow_duration=0.0, tot_fwd_pkts=1.0, tot_bwd_pkts=0.0, totlen_fwd_pkts=100.0)
    two = dict(flow_duration=200.0, tot_fwd_pkts=2.0, tot_bwd_pkts=2.0, totlen_fwd_pkts=200.0)
    df = spark.createDataFrame([("DoS-Hulk", *[r.get(c, 0.0) for c in order]) for r in (one, two)], columns)
    r = traffic.traffic_statistics(df).first()
    assert (r.flow_count, r.duration_mean, r.duration_min, r.duration_max) == (2, 100.0, 0.0, 200.0)
    assert (r.zero_duration_pct, r.unidirectional_pct, r.fwd_pkts_mean) == (50.0, 50.0, 1.5)
    single = traffic.traffic_statistics(df.limit(1)).first()
    assert single.duration_std == 0.0


def test_port_concentration_and_matrix(spark):
    df = spark.createDataFrame([("SSH-BruteForce", 22)] * 3 + [("SSH-BruteForce", 2222)], "label string, dst_port int")
    top = ports.top_ports(df, 2).orderBy("rank").collect()
    assert (top[0].port, top[0].service_name, top[0].percentage_within_class) == (22, "SSH (Secure Shell)", 75.0)
    assert (top[0].criticality_weight, top[1].criticality_weight) == (100, 50)
    assert top[1].service_name == "Custom / Unassigned (2222)"
    c = ports.port_concentration(df, 2).first()
    assert (c.concentration_top_1_port_pct, c.concentration_top_3_ports_pct) == (75.0, 100.0)
    assert not c.has_extreme_port_concentration and c.total_flows == 4
    cells = {r.port: (r.flow_count, r.heat_level) for r in ports.port_matrix(df).collect()}
    assert len(cells) == 12 and cells[22] == (3, "lvl-100") and cells[80] == (0, "lvl-0")


def test_top_port_ties_are_stable(spark):
    df = spark.createDataFrame([("x", p) for p in (9, 7, 8)], "label string, dst_port int")
    assert [r.port for r in ports.top_ports(df, 2).orderBy("rank").collect()] == [7, 8]


def test_correlations_and_constant_column(spark):
    df = spark.range(1, 10).selectExpr("double(id) a", "double(id * 2) b", "1.0D c", "IF(id = 3, NULL, double(-id)) d")
    pairs = [("a", "b", "x"), ("a", "c", "y"), ("a", "d", "z")]
    rows = redundancy.feature_correlations(df, pairs).orderBy("pair_no").collect()
    assert rows[0].pearson_correlation == pytest.approx(1.0) and rows[0].is_near_duplicate
    assert rows[1].pearson_correlation == 0.0 and not rows[1].is_strongly_collinear
    assert rows[2].pearson_correlation == pytest.approx(-1.0)
    count = redundancy.redundant_pair_count(redundancy.feature_correlations(df, pairs)).first()
    assert (count.evaluated_pairs_count, count.redundant_pairs_count) == (3, 2)


def test_pair_decisions(flows):
    rows = {r.feature_1: r for r in redundancy.classify_pairs(redundancy.feature_correlations(flows)).collect()}
    assert rows["tot_fwd_pkts"].pruned_feature == "subflow_fwd_pkts" and rows["tot_fwd_pkts"].is_pruned
    assert not rows["flow_duration"].is_pruned and rows["flow_duration"].pruned_feature is None
    assert len(rows) == len(dims.FEATURE_PAIRS)
    wanted = redundancy.classify_pairs(redundancy.feature_correlations(flows), "NEAR_DUPLICATE")
    assert {r.redundancy_class for r in wanted.collect()} == {"NEAR_DUPLICATE"}


def test_observations_follow_the_data(flows):
    rows = findings.observations(
        distribution.temporal_profile(flows), distribution.class_distribution(flows), ports.port_concentration(flows),
        redundancy.feature_correlations(flows), traffic.traffic_statistics(flows)).collect()
    assert [r.category for r in rows] == findings.CATEGORIES
    rare = flows.groupBy("label").count().where(F.col("count") < 500).count()
    assert rows[1].affected == rare


def test_correlations_take_one_scan(flows):
    plan = redundancy.feature_correlations(flows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") <= 1 or plan.count("Scan In-memory") <= 1
