"""Distribution, traffic, port and correlation queries."""

from pyspark.sql import functions as F

from catalog import query
from catalog.ctes import values, with_ctes
from catalog.views import flows, table
from flowintel import dims
from flowintel.operators import clean, distribution, findings, ports, redundancy, traffic


def _distribution_sql(source: str, label: str, reference: str) -> str:
    return f"""SELECT class_name, support, round(support::DOUBLE/sum(support) OVER ()*100,4) AS percentage,
 round(coalesce(sum(support) FILTER (WHERE class_name='{reference}') OVER (),0)::DOUBLE/support,2) AS ratio_to_benign,
 support<10000 AS is_rare_class, support<500 AS is_ultra_rare
 FROM (SELECT {label} AS class_name, count(*) AS support FROM {source} GROUP BY 1)"""


@query("class_distribution", with_ctes(_distribution_sql("clean", "label", "Benign"), "clean"))
def class_distribution(spark, sf):
    return distribution.class_distribution(flows(spark, sf))


@query("event_type_distribution", _distribution_sql("events", "event_type", "view"))
def event_type_distribution(spark, sf):
    return distribution.class_distribution(table(spark, sf, "events"), "event_type", "view")


@query("class_counts", with_ctes('SELECT label, count(*) AS "count" FROM clean GROUP BY 1', "clean"))
def class_counts(spark, sf):
    return distribution.class_counts(flows(spark, sf))


_IMBALANCE = """SELECT {label}, "count", round("count"::DOUBLE/sum("count") OVER ()*100,6) AS percentage,
 round(max("count") OVER ()::DOUBLE/"count",1) AS imbalance_ratio FROM (SELECT {label}, count(*) AS "count" FROM {source} GROUP BY 1)"""


@query("imbalance", with_ctes(_IMBALANCE.format(label="label", source="clean"), "clean"))
def imbalance(spark, sf):
    return distribution.imbalance(flows(spark, sf)).withColumn("percentage", F.round("percentage", 6))


@query("order_priority_imbalance", _IMBALANCE.format(label="o_orderpriority", source="orders"))
def order_priority_imbalance(spark, sf):
    return distribution.imbalance(table(spark, sf, "orders"), "o_orderpriority").withColumn(
        "percentage", F.round("percentage", 6))


@query("label_date_counts", with_ctes(
    "SELECT class_name, event_date::VARCHAR AS event_date, flow_count FROM label_dates", "label_dates"))
def label_date_counts(spark, sf):
    return distribution.label_date_counts(flows(spark, sf)).withColumn("event_date", F.col("event_date").cast("string"))


def _temporal_sql(source: str, need_daily: str) -> str:
    return f"""SELECT t.class_name, t.active_days_count, t.primary_event_date::VARCHAR AS primary_event_date,
 t.primary_day_count, round(t.primary_day_count::DOUBLE/t.total*100,2) AS primary_day_percentage,
 t.active_days_count=1 AND t.class_name<>'Benign' AS is_single_day_attack,
 (SELECT string_agg(event_date::VARCHAR || '=' || flow_count, ',' ORDER BY event_date) FROM {need_daily} d
  WHERE d.class_name=t.class_name) AS daily_counts FROM {source} t"""


def _daily_text(df):
    text = F.transform(F.map_entries("daily_counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return df.withColumns({
        "daily_counts": F.array_join(text, ","), "primary_event_date": F.col("primary_event_date").cast("string")})


@query("temporal_profile", with_ctes(_temporal_sql("temporal", "label_dates"), "temporal"))
def temporal_profile(spark, sf):
    return _daily_text(distribution.temporal_profile(flows(spark, sf)))


@query("event_temporal_profile",
       "WITH label_dates AS (SELECT event_type AS class_name, ts::DATE AS event_date, count(*) AS flow_count FROM events GROUP BY 1,2),"
       " temporal AS (SELECT class_name, count(*) AS active_days_count,"
       " arg_max(event_date, flow_count*1000000-(event_date-DATE '1970-01-01')) AS primary_event_date,"
       " max(flow_count) AS primary_day_count, sum(flow_count) AS total FROM label_dates GROUP BY 1) "
       + _temporal_sql("temporal", "label_dates"))
def event_temporal_profile(spark, sf):
    return _daily_text(distribution.temporal_profile(table(spark, sf, "events"), "event_type", "ts"))


@query("date_totals", with_ctes(
    "SELECT event_date::VARCHAR AS event_date, count(*) AS total_flows, strftime(event_date,'%m/%d %a') AS day_label,"
    " count(*) OVER () AS horizon_days FROM clean GROUP BY clean.event_date", "clean"))
def date_totals(spark, sf):
    return distribution.date_totals(flows(spark, sf)).withColumn("event_date", F.col("event_date").cast("string"))


@query("date_label_pivot", with_ctes(
    "SELECT event_date::VARCHAR AS event_date, " + ", ".join(
        f"count(*) FILTER (WHERE label='{c}') AS \"{c}\"" for c in dims.CLASS_LABELS)
    + " FROM clean GROUP BY 1", "clean"))
def date_label_pivot(spark, sf):
    return distribution.date_label_pivot(flows(spark, sf)).withColumn("event_date", F.col("event_date").cast("string"))


def _stat(fn, col, name):
    return f"round(coalesce({fn}({col}),0),2) AS {name}"


@query("traffic_stats", with_ctes("SELECT label AS class_name, count(*) AS flow_count, " + ", ".join([
    _stat("avg", "flow_duration", "duration_mean"), _stat("stddev_samp", "flow_duration", "duration_std"),
    _stat("min", "flow_duration", "duration_min"), _stat("max", "flow_duration", "duration_max"),
    "count(*) FILTER (WHERE flow_duration=0) AS zero_duration_flows",
    "round(count(*) FILTER (WHERE flow_duration=0)::DOUBLE/count(*)*100,3) AS zero_duration_pct",
    _stat("avg", "flow_pkts_s", "pkts_per_sec_mean"), _stat("stddev_samp", "flow_pkts_s", "pkts_per_sec_std"),
    _stat("max", "flow_pkts_s", "pkts_per_sec_max"), _stat("avg", "flow_byts_s", "bytes_per_sec_mean"),
    _stat("stddev_samp", "flow_byts_s", "bytes_per_sec_std"), _stat("max", "flow_byts_s", "bytes_per_sec_max"),
    _stat("avg", "tot_fwd_pkts", "fwd_pkts_mean"), _stat("stddev_samp", "tot_fwd_pkts", "fwd_pkts_std"),
    _stat("avg", "tot_bwd_pkts", "bwd_pkts_mean"), _stat("stddev_samp", "tot_bwd_pkts", "bwd_pkts_std"),
    "count(*) FILTER (WHERE tot_bwd_pkts=0) AS unidirectional_zero_bwd_flows",
    "round(count(*) FILTER (WHERE tot_bwd_pkts=0)::DOUBLE/count(*)*100,3) AS unidirectional_pct",
    _stat("avg", "down_up_ratio", "down_up_ratio_mean"), _stat("avg", "totlen_fwd_pkts", "fwd_bytes_mean"),
    _stat("avg", "totlen_bwd_pkts", "bwd_bytes_mean"), _stat("avg", "pkt_size_avg", "pkt_size_avg_mean"),
]) + " FROM clean GROUP BY 1", "clean"))
def traffic_stats(spark, sf):
    return traffic.traffic_statistics(flows(spark, sf))


@query("port_top_n", with_ctes("SELECT * FROM top_ports", "top_ports"))
def port_top_n(spark, sf):
    return ports.top_ports(flows(spark, sf))


@query("port_concentration", with_ctes(
    "SELECT c.*, concentration_top_1_port_pct>=90 AS has_extreme_port_concentration,"
    " (SELECT string_agg(port || ':' || flow_count, ',' ORDER BY rank) FROM top_ports t WHERE t.class_name=c.class_name) AS top_ports"
    " FROM concentration c", "concentration"))
def port_concentration(spark, sf):
    text = F.transform("top_ports", lambda p: F.concat_ws(":", p["port"].cast("string"), p["flow_count"].cast("string")))
    return ports.port_concentration(flows(spark, sf)).withColumn("top_ports", F.array_join(text, ","))


@query("port_matrix", with_ctes(
    "SELECT c.class_name, c.total_flows, CAST(m.port AS INTEGER) AS port, coalesce(t.flow_count,0) AS flow_count,"
    " coalesce(t.percentage_within_class,0) AS percentage_within_class,"
    " CASE WHEN coalesce(t.percentage_within_class,0)<=0 THEN 'lvl-0' WHEN t.percentage_within_class<25 THEN 'lvl-25'"
    " WHEN t.percentage_within_class<50 THEN 'lvl-50' WHEN t.percentage_within_class<75 THEN 'lvl-75' ELSE 'lvl-100' END AS heat_level"
    " FROM concentration c CROSS JOIN (VALUES " + values((p,) for p in dims.MATRIX_PORTS) + ") m(port)"
    " LEFT JOIN top_ports t ON t.class_name=c.class_name AND t.port=m.port", "concentration"))
def port_matrix(spark, sf):
    return ports.port_matrix(flows(spark, sf))


@query("port_lookups", with_ctes(
    "SELECT label, sum(coalesce(known_criticality,50)) ::BIGINT AS criticality_total,"
    " count(*) FILTER (WHERE known_service IS NULL) AS unlisted_services FROM clean"
    " LEFT JOIN services s ON dst_port=s.port LEFT JOIN criticality c ON dst_port=c.port GROUP BY 1",
    "clean", "services", "criticality"))
def port_lookups(spark, sf):
    joined = ports.add_port_criticality(ports.add_port_service(flows(spark, sf), "dst_port"), "dst_port")
    return joined.groupBy("label").agg(
        F.sum("criticality_weight").alias("criticality_total"),
        F.count_if(F.col("service_name").startswith("Custom / Unassigned")).alias("unlisted_services"))


_PAIRS = ("SELECT pair_no, feature_1, feature_2, description, r AS pearson_correlation, abs(r)>=0.999 AS is_near_duplicate,"
          " abs(r)>=0.85 AS is_strongly_collinear, CASE WHEN abs(r)>=0.999 THEN 'Drop ' || feature_2 || ' (redundant duplicate of ' ||"
          " feature_1 || ')' ELSE 'Retain or monitor in tree feature importance' END AS recommendation FROM (" + " UNION ALL ".join(
              f"SELECT {i} AS pair_no, '{a}' AS feature_1, '{b}' AS feature_2, '{t}' AS description,"
              f" coalesce(round(corr({a},{b}),6),0) AS r FROM clean" for i, (a, b, t) in enumerate(dims.FEATURE_PAIRS)) + ")")


@query("feature_correlations", with_ctes(_PAIRS, "clean"))
def feature_correlations(spark, sf):
    return redundancy.feature_correlations(flows(spark, sf))


@query("redundant_pair_count", with_ctes(
    "SELECT count(*) AS evaluated_pairs_count, count(*) FILTER (WHERE is_near_duplicate OR is_strongly_collinear) AS redundant_pairs_count,"
    f" count(*) FILTER (WHERE is_near_duplicate) AS near_duplicate_pairs_count FROM ({_PAIRS})", "clean"))
def redundant_pair_count(spark, sf):
    return redundancy.redundant_pair_count(redundancy.feature_correlations(flows(spark, sf)))


_PRUNED = "(" + ",".join(f"'{c}'" for c in dims.COLLINEAR_COLUMNS) + ")"


@query("pair_decisions", with_ctes(
    "SELECT feature_1, feature_2, CASE WHEN is_near_duplicate THEN 'NEAR_DUPLICATE' WHEN is_strongly_collinear THEN"
    f" 'STRONGLY_COLLINEAR' ELSE 'NON_COLLINEAR' END AS redundancy_class, (feature_1 IN {_PRUNED})<>(feature_2 IN {_PRUNED}) AS is_pruned,"
    f" CASE WHEN feature_1 IN {_PRUNED} AND feature_2 NOT IN {_PRUNED} THEN feature_1 WHEN feature_2 IN {_PRUNED} AND feature_1 NOT IN {_PRUNED}"
    f" THEN feature_2 END AS pruned_feature, CASE WHEN feature_1 IN {_PRUNED} AND feature_2 NOT IN {_PRUNED} THEN feature_2"
    f" WHEN feature_2 IN {_PRUNED} AND feature_1 NOT IN {_PRUNED} THEN feature_1 END AS retained_feature FROM ({_PAIRS})", "clean"))
def pair_decisions(spark, sf):
    return redundancy.classify_pairs(redundancy.feature_correlations(flows(spark, sf))).select(
        "feature_1", "feature_2", "redundancy_class", "is_pruned", "pruned_feature", "retained_feature")


@query("order_measure_correlation",
       "SELECT 'o_totalprice' AS feature_1, 'o_custkey' AS feature_2, round(corr(o_totalprice,o_custkey),6) AS pearson_correlation FROM orders")
def order_measure_correlation(spark, sf):
    return redundancy.feature_correlations(
        table(spark, sf, "orders").withColumn("o_custkey", F.col("o_custkey").cast("double")),
        [("o_totalprice", "o_custkey", "price vs customer")]).select("feature_1", "feature_2", "pearson_correlation")


@query("observations", with_ctes(
    "SELECT *, printf('%d of %d evaluated entries show this trait', affected, evaluated) AS finding FROM ("
    "SELECT 'Train/Test Splitting Strategy' AS category, count(*) FILTER (WHERE active_days_count=1) AS affected, count(*) AS evaluated"
    " FROM temporal WHERE class_name<>'Benign' UNION ALL "
    "SELECT 'Extreme Class Imbalance Handling', count(*) FILTER (WHERE n<500), count(*) FROM (SELECT label, count(*) AS n FROM clean GROUP BY 1) UNION ALL "
    "SELECT 'Port Shortcut Learning Risk', count(*) FILTER (WHERE concentration_top_1_port_pct>=90), count(*) FROM concentration UNION ALL "
    f"SELECT 'Feature Redundancy Elimination', count(*) FILTER (WHERE is_near_duplicate), count(*) FROM ({_PAIRS}) UNION ALL "
    "SELECT 'Unidirectional Flow Signature', count(*) FILTER (WHERE n>0), count(*) FROM"
    " (SELECT label, count(*) FILTER (WHERE tot_bwd_pkts=0) AS n FROM clean GROUP BY 1))", "temporal", "concentration", "clean"))
def observations(spark, sf):
    df = flows(spark, sf)
    return findings.observations(
        distribution.temporal_profile(df), distribution.class_distribution(df), ports.port_concentration(df),
        redundancy.feature_correlations(df), traffic.traffic_statistics(df))


_QUALITY = ["flow_duration", "flow_byts_s", "fwd_pkts_s", "down_up_ratio", "totlen_fwd_pkts"]


@query("raw_feature_quality", with_ctes(" UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, count(*) FILTER (WHERE v IS NULL) AS null_count,"
    f" count(*) FILTER (WHERE isnan(v) OR isinf(v)) AS non_finite_count FROM"
    f" (SELECT label, TRY_CAST({c} AS DOUBLE) AS v FROM raw WHERE label<>'Label') GROUP BY 1" for c in _QUALITY), "raw"))
def raw_feature_quality(spark, sf):
    from catalog.views import raw_flows

    rows = clean.rename_columns(clean.without_repeated_headers(raw_flows(spark, sf)))
    typed = rows.select("label", *[F.col(c).try_cast("double").alias(c) for c in _QUALITY])
    return clean.feature_quality(typed, _QUALITY, "label")
