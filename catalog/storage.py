"""Manifest, result-table, verification and provenance queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import ORACLES, query
from catalog.ctes import MANIFEST, RUN_ID, values, with_ctes
from catalog.views import TABLES, campaign_profiles, discarded, flows, predictions, raw_flows, scratch, table
from flowintel import dims
from flowintel.functions import timeparse
from flowintel.operators import evaluate, lookups, ports, report, results
from flowintel.plans import jobs
from flowintel.session import checkpointed
from flowintel.sources import files, manifest, tables


def _documents(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    return rows


_ENTRIES = "SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, strlen(text) AS size_bytes, doc_id FROM documents"


@query("manifest_entries", f"SELECT path, sha256, size_bytes FROM ({_ENTRIES})")
def manifest_entries(spark, sf):
    return manifest.entries_from_content(_documents(spark, sf), "path", "text")


def _digest(columns: list[str]) -> str:
    """SQL aggregate: the content digest of rows with these text columns."""
    text = " || ".join(f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || length({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in columns)
    sums = " || ',' || ".join(
        f"coalesce(sum(CAST('0x' || substr(sha256({text}),{8 * i + 1},8) AS HUGEINT)),0)::HUGEINT::VARCHAR" for i in range(8))
    return f"sha256(count(*) || ',' || {sums})"


@query("manifest_digest",
       f"SELECT substr({_digest(['path', 'sha256', 'size_bytes'])},1,16) AS source_manifest_hash, count(*) AS files_count,"
       f" CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ({_ENTRIES})")
def manifest_digest(spark, sf):
    return manifest.manifest(manifest.entries_from_content(_documents(spark, sf), "path", "text"))


@query("table_manifest", "SELECT name || '.parquet' AS path, true AS same_digest, true AS same_size, true AS same_manifest FROM ("
       + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES) + ") WHERE n >= 0")
def table_manifest(spark, sf):
    """Streamed digests of the tables' files beside those of the files read otherwise (whole, where a task can hold them),
    and whether the manifest of a shuffled list of the files equals that of the folder."""
    streamed = manifest.file_entries(spark, sf)
    whole = manifest.whole_entries(spark, sf).select("path", F.col("sha256").alias("whole_sha256"), F.col("size_bytes").alias("length"))
    shuffled = manifest.file_entries(spark, [f"{sf}/{t}.parquet" for t in reversed(TABLES)], base=sf)
    hashes = [manifest.manifest(e).select("source_manifest_hash").scalar() for e in (streamed, shuffled)]
    return streamed.join(whole, "path").select(
        "path", (F.col("sha256") == F.col("whole_sha256")).alias("same_digest"),
        (F.col("size_bytes") == F.col("length")).alias("same_size"), (hashes[0] == hashes[1]).alias("same_manifest"))


_HALVES = f"WITH e AS ({_ENTRIES}), known AS (SELECT * FROM e WHERE doc_id%2=0), incoming AS (SELECT * FROM e WHERE doc_id%2=1)"


def _halves(spark, sf):
    rows = _documents(spark, sf)
    return tuple(
        manifest.entries_from_content(rows.where(F.col("doc_id") % 2 == part), "path", "text") for part in (1, 0))


@query("duplicate_files", _HALVES + " SELECT path, sha256, size_bytes FROM incoming WHERE sha256 IN (SELECT sha256 FROM known)")
def duplicate_files(spark, sf):
    incoming, known = _halves(spark, sf)
    return manifest.duplicate_files(incoming, known)


@query("novel_files", _HALVES + " SELECT min(path) AS path, sha256, min(size_bytes) AS size_bytes FROM incoming"
       " WHERE sha256 NOT IN (SELECT sha256 FROM known) GROUP BY sha256")
def novel_files(spark, sf):
    incoming, known = _halves(spark, sf)
    return manifest.novel_files(incoming, known)


# runs: one per event day
_RUNS = """SELECT 'run_' || strftime(d,'%Y%m%d') AS run_id, strftime(last,'%Y-%m-%d %H:%M:%S.%f') AS run_timestamp, n AS total_profiles FROM
 (SELECT ts::DATE AS d, max(ts) AS last, count(*) AS n FROM events GROUP BY 1)"""


def _runs(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(
        F.max("ts").alias("run_timestamp"), F.count("*").alias("total_profiles"))
    return days.select(
        F.concat(F.lit("run_"), F.date_format("d", "yyyyMMdd")).alias("run_id"), "run_timestamp", "total_profiles")


def _run_text(df):
    return df.withColumn("run_timestamp", F.date_format("run_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("latest_run", f"SELECT * FROM ({_RUNS}) ORDER BY run_timestamp DESC LIMIT 1")
def latest_run(spark, sf):
    return _run_text(lookups.latest_run(_runs(spark, sf)))


@query("run_page", f"SELECT * FROM ({_RUNS}) ORDER BY run_timestamp DESC, run_id LIMIT 10 OFFSET 5")
def run_page(spark, sf):
    return _run_text(lookups.recent_runs(_runs(spark, sf), limit=10, offset=5))


@query("run_lookup", f"SELECT * FROM ({_RUNS}) WHERE run_id='run_20240105'")
def run_lookup(spark, sf):
    return _run_text(lookups.rows_for_run(_runs(spark, sf), "run_20240105"))


@query("run_summary", with_ctes(
    f"SELECT '{RUN_ID}' AS run_id, '{MANIFEST}' AS source_manifest_hash, count(*)::INTEGER AS total_profiles,"
    " (count(*) FILTER (WHERE is_attack))::INTEGER AS attack_categories_count, (count(*) FILTER (WHERE NOT is_attack))::INTEGER AS benign_categories_count,"
    " (count(*) FILTER (WHERE is_attack IS NULL))::INTEGER AS unknown_categories_count, 'curated_dataset_flows' AS provenance_type,"
    " '2018-03-03 00:00:00' AS window_end FROM campaign_profiles", "campaign_profiles"))
def run_summary(spark, sf):
    source = spark.range(1).select(
        F.lit(MANIFEST).alias("source_manifest_hash"), F.lit(1).alias("files_count"), F.lit(1).cast("bigint").alias("total_bytes"))
    run = results.run_row(campaign_profiles(spark, sf), source, RUN_ID, F.current_timestamp(), sf)
    return run.select(
        "run_id", "source_manifest_hash", "total_profiles", "attack_categories_count", "benign_categories_count",
        "unknown_categories_count", "provenance_type", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"))


@query("result_profiles", with_ctes(
    "SELECT snapshot_id, profile_id, canonical_label, is_attack, flow_count, total_bytes, total_packets, active_observation_units,"
    " round(active_observation_units::DOUBLE/recurrence_denominator,4) AS recurrence_ratio FROM hourly_profiles", "hourly_profiles"))
def result_profiles(spark, sf):
    return results.profile_rows(campaign_profiles(spark, sf, "hourly")).select(
        "snapshot_id", "profile_id", "canonical_label", "is_attack", "flow_count", "total_bytes", "total_packets",
        "active_observation_units", F.col("recurrence_ratio").cast("double").alias("recurrence_ratio"))


@query("result_risk", with_ctes(
    "SELECT snapshot_id, round(severity,2) AS severity_score, round(frequency,2) AS frequency_score, round(recurrence,2) AS recurrence_score,"
    " NULL::DOUBLE AS target_impact_score, tlrs_normalized_rounded, false AS is_confirmed FROM hourly_profiles", "hourly_profiles"))
def result_risk(spark, sf):
    rows = results.risk_rows(campaign_profiles(spark, sf, "hourly"))
    scores = ["severity_score", "frequency_score", "recurrence_score", "target_impact_score"]
    return rows.select(
        "snapshot_id", *[F.col(c).cast("double").alias(c) for c in scores], "tlrs_normalized_rounded", "is_confirmed")


@query("result_mappings", with_ctes(
    "SELECT snapshot_id, canonical_label, technique_id, mapping_status, mapping_status='verified' AS is_confirmed,"
    " len(missing_telemetry)::INTEGER AS telemetry_gaps FROM daily_profiles", "daily_profiles"))
def result_mappings(spark, sf):
    return results.mapping_rows(campaign_profiles(spark, sf, "daily")).select(
        "snapshot_id", "canonical_label", "technique_id", "mapping_status", "is_confirmed",
        F.size("missing_telemetry").alias("telemetry_gaps"))


@query("orphan_lines", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN"
       " (SELECT o_orderkey FROM orders WHERE o_orderstatus<>'F') GROUP BY 1")
def orphan_lines(spark, sf):
    parents = table(spark, sf, "orders").where(F.col("o_orderstatus") != "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return results.orphans(table(spark, sf, "lineitem"), parents, "l_orderkey").groupBy("l_orderkey").agg(
        F.count("*").alias("n"))


@query("surviving_rows", with_ctes(
    "SELECT 'threat_profiles' AS table_name, count(*) AS n FROM hourly_profiles WHERE window_start NOT LIKE '2018-02-15%'"
    " UNION ALL SELECT 'mitre_mappings', count(*) FROM hourly_profiles WHERE window_start NOT LIKE '2018-02-15%'"
    " UNION ALL SELECT 'pipeline_runs', count(DISTINCT window_start[1:10]) FROM hourly_profiles WHERE window_start NOT LIKE '2018-02-15%'", "hourly_profiles"))
def surviving_rows(spark, sf):
    """Deleting the run of one day removes its profiles and their children."""
    built = checkpointed(campaign_profiles(spark, sf, "hourly").withColumn("run_id", F.substring("window_start", 1, 10)))
    tables = results.result_tables(built, built.select("run_id").distinct())
    kept = results.surviving_tables(tables, "2018-02-15")
    names = ["threat_profiles", "mitre_mappings", "pipeline_runs"]
    counts = [kept[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _cells_table(spark, sf):
    return evaluate.dense_matrix(checkpointed(evaluate.contingency(predictions(spark, sf), by=["split"])), ["split"])


_HASH, _STAMP = "f" * 64, "2024-01-01T00:00:00"


def _stored_cells(spark, sf):
    return results.confusion_rows(_cells_table(spark, sf), F.lit(_HASH), F.lit(_STAMP), "flow-classifier", "model")


@query("confusion_rows", with_ctes(
    f"SELECT '{_HASH}' AS source_report_hash, CASE split WHEN 'val' THEN 'validation' ELSE split END AS evaluated_split, true_label, predicted_label,"
    " true_idx AS true_label_idx, pred_idx AS predicted_label_idx, raw_count, true_class_support, normalized_ratio, NULL::VARCHAR AS run_id FROM dense", "dense"))
def confusion_rows(spark, sf):
    return _stored_cells(spark, sf).select(
        "source_report_hash", "evaluated_split", "true_label", "predicted_label", "true_label_idx", "predicted_label_idx",
        "raw_count", "true_class_support", F.col("normalized_ratio").cast("double").alias("normalized_ratio"), "run_id")


@query("port_rows", with_ctes(
    "SELECT class_name AS threat_category, port AS destination_port, service_name, criticality_weight, flow_count, t.total_flows AS total_class_flows,"
    " percentage_within_class, concentration_top_1_port_pct>=90 AS has_extreme_concentration FROM top_ports t JOIN concentration USING (class_name)", "concentration"))
def port_rows(spark, sf):
    rows = results.port_rows(ports.port_concentration(flows(spark, sf)), F.lit(_HASH), F.lit(_STAMP), "flow-analytics", sf)
    return rows.select(
        "threat_category", "destination_port", "service_name", "criticality_weight", "flow_count", "total_class_flows",
        F.col("percentage_within_class").cast("double").alias("percentage_within_class"), "has_extreme_concentration")


@query("matrix_shape", with_ctes(
    "SELECT CASE split WHEN 'val' THEN 'validation' ELSE split END AS evaluated_split, count(*) AS cells, count(DISTINCT true_idx) AS true_classes,"
    " count(DISTINCT pred_idx) AS predicted_classes, count(*)=196 AS complete FROM dense GROUP BY 1", "dense"))
def matrix_shape(spark, sf):
    return results.matrix_shape(_stored_cells(spark, sf))


def _rule_counts(rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {t}) AS violations FROM {source}" for n, t in rules.items())


@query("confusion_payload_rules", with_ctes(_rule_counts(results.CONFUSION_RULES,
    "(SELECT true_idx AS true_label_idx, pred_idx AS predicted_label_idx, * FROM dense)"), "dense"))
def confusion_payload_rules(spark, sf):
    return results.check_rules(_stored_cells(spark, sf), results.CONFUSION_RULES)


_PORT_PAYLOAD = """(SELECT l_partkey*5-100 AS destination_port, l_quantity*3-2 AS percentage_within_class,
 l_suppkey%50-1 AS flow_count, l_linenumber-1 AS total_class_flows FROM lineitem)"""


@query("port_payload_rules", _rule_counts(results.PORT_RULES, _PORT_PAYLOAD))
def port_payload_rules(spark, sf):
    """Rules over a payload with violations of every kind."""
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_partkey*5-100 AS destination_port", "l_quantity*3-2 AS percentage_within_class",
        "l_suppkey%50-1 AS flow_count", "l_linenumber-1 AS total_class_flows")
    return results.check_rules(rows, results.PORT_RULES)


@query("cell_verification", with_ctes(
    "SELECT split, true_idx, pred_idx, CASE WHEN true_idx=3 THEN 'missing_in_store' WHEN pred_idx=5 THEN 'different' END AS problem FROM dense"
    " WHERE true_idx=3 OR pred_idx=5", "dense"))
def cell_verification(spark, sf):
    """Stored cells with one row dropped and one column altered, against their source."""
    source = checkpointed(_cells_table(spark, sf))
    altered = F.col("raw_count") + F.when(F.col("pred_idx") == 5, 1).otherwise(0)
    stored = source.where(F.col("true_idx") != 3).withColumn("raw_count", altered)
    return results.mismatches(
        stored, source, ["split", "true_idx", "pred_idx"], ["raw_count", "true_class_support", "normalized_ratio"])


@query("verification_summary", with_ctes(
    "SELECT 'stored_rows' AS measure, count(*) AS n FROM top_ports WHERE rank<>4 UNION ALL SELECT 'source_rows', count(*) FROM top_ports"
    " UNION ALL SELECT 'mismatches', count(*) FROM top_ports WHERE rank=4 OR port%2=1", "top_ports"))
def verification_summary(spark, sf):
    """Stored ports with the fourth of each class lost and counts of odd ports altered, against their source."""
    source = checkpointed(ports.top_ports(flows(spark, sf)))
    altered = F.col("flow_count") + F.col("port") % 2
    stored = source.where(F.col("rank") != 4).withColumn("flow_count", altered)
    return results.verification_summary(
        stored, source, ["class_name", "port"], ["flow_count", "total_flows", "percentage_within_class"])


_ORDERS = "SELECT * REPLACE (o_totalprice::DECIMAL(18,2) AS o_totalprice) FROM orders"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_SUPPLIERS = "SELECT * REPLACE (s_acctbal::DECIMAL(18,2) AS s_acctbal) FROM supplier"
_SUPPLIER_COLUMNS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


@query("table_hash", f"SELECT count(*) AS row_count, {_digest(_ORDER_COLUMNS)} AS content_hash FROM ({_ORDERS})")
def table_hash(spark, sf):
    """All columns; amounts as decimals, whose text is the same everywhere."""
    orders = table(spark, sf, "orders")
    return results.table_hash(orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), _ORDER_COLUMNS)


@query("ordered_table_hash", f"SELECT count(*) AS row_count, {_digest(_SUPPLIER_COLUMNS)} AS content_hash FROM ({_SUPPLIERS})")
def ordered_table_hash(spark, sf):
    suppliers = table(spark, sf, "supplier")
    return results.ordered_table_hash(
        suppliers.withColumn("s_acctbal", F.col("s_acctbal").cast("decimal(18,2)")), "s_suppkey", _SUPPLIER_COLUMNS)


@query("provenance_link",
       "SELECT o_orderkey::VARCHAR AS run_id, true AS run_found, o_orderkey%3<>0 AS model_matches, o_orderkey%5<>0 AS dataset_matches,"
       " CASE WHEN o_orderkey%3<>0 AND o_orderkey%5<>0 THEN o_orderkey::VARCHAR END AS linked_run_id FROM (SELECT DISTINCT o_orderkey FROM orders)")
def provenance_link(spark, sf):
    """Order keys as runs; every third report names another model, every fifth another dataset."""
    keys = table(spark, sf, "orders").select("o_orderkey").distinct()
    run = F.col("o_orderkey").cast("string").alias("run_id")
    runs = keys.select(run, F.lit("models/rf/model").alias("model_artifact"), F.lit("data/flows.parquet").alias("dataset_path"))
    model = F.when(F.col("o_orderkey") % 3 == 0, "models/other").otherwise("Models\\RF\\model\\")
    data = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("./DATA/flows.parquet")
    reports = keys.select(run, model.alias("model_location"), data.alias("dataset_path"))
    return results.provenance_link(runs, reports)


@query("normalized_paths", "SELECT url, regexp_replace(lower(url), '(.)/+$', '\\1') AS normalized FROM pages")
def normalized_paths(spark, sf):
    return table(spark, sf, "pages").select("url", timeparse.normalized_path(F.col("url")).alias("normalized"))


@query("report_tables", with_ctes(
    "SELECT 'dates' AS section, event_date::VARCHAR AS name, '' AS part, count(*)::DOUBLE AS value FROM clean GROUP BY ALL UNION ALL"
    " SELECT 'temporal', class_name, event_date::VARCHAR, flow_count FROM label_dates UNION ALL"
    " SELECT 'ports', class_name, port::VARCHAR, percentage_within_class FROM top_ports UNION ALL "
    + " UNION ALL ".join(f"SELECT 'pairs', '{a}', '{b}', coalesce(round(corr({a},{b}),6),0) FROM clean" for a, b, _ in dims.FEATURE_PAIRS),
    "clean", "label_dates", "top_ports"))
def report_tables(spark, sf):
    """All rows of the flat report tables, read from the sections of the analytics job."""
    flat = jobs.report_tables(jobs.analytics_sections(flows(spark, sf)))
    shown = {"dates": ("event_date", "''", "total_flows"), "temporal": ("class_name", "event_date", "flow_count"),
             "ports": ("class_name", "port", "percentage_within_class"), "pairs": ("feature_1", "feature_2", "pearson_correlation")}
    parts = [flat[section].selectExpr(
        f"'{section}' AS section", f"string({name}) AS name", f"string({part}) AS part", f"double({value}) AS value")
        for section, (name, part, value) in shown.items()]
    return reduce(DataFrame.unionByName, parts)


# Rows of a capture: their text takes about 12 GB, three times what is stored of them.
CAPTURE_ROWS = 36_000_000


@query("cleaning_job", ORACLES["clean_metrics"])
def cleaning_job(spark, sf):
    """Row accounting of the whole cleaning job, from CSV files of the flows to stored Parquet.

    The flows come as captures of bounded size, each as CSV files that go once they are stored beside the flows before.
    """
    path, totals = scratch(spark, "cleaning"), []
    captures = max(1, -(-table(spark, sf, "lineitem").count() // CAPTURE_ROWS))
    for i in range(captures):
        raw_flows(spark, sf, share=(i, captures)).drop("source_file").write.option("header", True).csv(f"{path}/raw-{i}")
        totals.append(jobs.run_cleaning(spark, f"{path}/raw-{i}", f"{path}/flows", append=i > 0)["row_accounting"])
        tables.remove_path(spark, f"{path}/raw-{i}")
    added = reduce(DataFrame.unionByName, totals)
    return discarded(spark, path, added.agg(*[F.sum(c).alias(c) for c in added.columns]))


@query("curated_by_date", with_ctes(
    "SELECT event_date::VARCHAR AS event_date, count(*) AS rows_stored, true AS has_files FROM clean GROUP BY 1", "clean"))
def curated_by_date(spark, sf):
    """Rows per date of the stored flows, beside the listing of their partitions."""
    path = scratch(spark, "curated")
    tables.write_curated(flows(spark, sf), path, rebalance=True)
    counted = files.read_curated(spark, path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("rows_stored"))
    return discarded(spark, path, counted.join(files.storage_layout(spark, path), "event_date").select(
        "event_date", "rows_stored", ((F.col("files_count") > 0) & (F.col("total_bytes") > 0)).alias("has_files")))


@query("analytics_job", ORACLES["class_distribution"])
def analytics_job(spark, sf):
    """Class distribution out of the stored report of the analytics job."""
    path = scratch(spark, "analytics")
    tables.write_curated(flows(spark, sf), f"{path}/flows", rebalance=True)
    return discarded(spark, path, jobs.run_analytics(spark, f"{path}/flows", f"{path}/report")["class_distribution"])


@query("threat_job", with_ctes(
    "SELECT profile_id, canonical_label, is_attack, flow_count, total_bytes, total_packets, active_observation_units FROM daily_profiles",
    "daily_profiles"))
def threat_job(spark, sf):
    """Daily profiles as the threat job stored them, through its report document into a second store."""
    path = scratch(spark, "threats")
    tables.write_curated(flows(spark, sf), f"{path}/flows", rebalance=True)
    jobs.run_threat_intelligence(spark, f"{path}/flows", f"{path}/store", RUN_ID, window_type="daily", report_path=f"{path}/report")
    jobs.load_stored_report(spark, f"{path}/report", f"{path}/second")
    return discarded(spark, path, tables.read_table(spark, f"{path}/second", "threat_profiles", RUN_ID).select(
        "profile_id", "canonical_label", "is_attack", "flow_count", "total_bytes", "total_packets", "active_observation_units"))


@query("report_run", ORACLES["run_summary"])
def report_run(spark, sf):
    """The run's row after a way through the JSON header of its report."""
    source = spark.range(1).select(
        F.lit(MANIFEST).alias("source_manifest_hash"), F.lit(1).alias("files_count"), F.lit(1).cast("bigint").alias("total_bytes"))
    run = results.run_row(campaign_profiles(spark, sf), source, RUN_ID, F.current_timestamp(), sf)
    return report.parsed_headers(report.header_lines(run)).select(
        "run_id", "source_manifest_hash", "total_profiles", "attack_categories_count", "benign_categories_count",
        "unknown_categories_count", "provenance_type", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"))


@query("report_profiles", ORACLES["result_profiles"])
def report_profiles(spark, sf):
    """Hourly profiles after a way through the JSON lines of their report."""
    read = report.parsed_profiles(report.profile_lines(campaign_profiles(spark, sf, "hourly")))
    return results.profile_rows(read).select(
        "snapshot_id", "profile_id", "canonical_label", "is_attack", "flow_count", "total_bytes", "total_packets",
        "active_observation_units", F.col("recurrence_ratio").cast("double").alias("recurrence_ratio"))


@query("report_mappings", ORACLES["result_mappings"])
def report_mappings(spark, sf):
    """Technique mappings of daily profiles out of one JSON document."""
    profiles = campaign_profiles(spark, sf, "daily")
    source = spark.range(1).select(
        F.lit(MANIFEST).alias("source_manifest_hash"), F.lit(1).alias("files_count"), F.lit(1).cast("bigint").alias("total_bytes"))
    run = results.run_row(profiles, source, RUN_ID, F.current_timestamp(), sf)
    read = report.document_profiles(report.single_document(run, profiles))
    return results.mapping_rows(read).select(
        "snapshot_id", "canonical_label", "technique_id", "mapping_status", "is_confirmed",
        F.size("missing_telemetry").alias("telemetry_gaps"))


@query("dimension_coverage",
       "SELECT n_name, count(*) AS suppliers, CAST(sum(CASE WHEN p.known IS NULL THEN 50 ELSE p.known END) AS BIGINT) AS criticality FROM supplier"
       " JOIN nation ON s_nationkey=n_nationkey LEFT JOIN (VALUES " + values(dims.PORT_CRITICALITY.items())
       + ") p(port, known) ON s_suppkey=p.port GROUP BY 1")
def dimension_coverage(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf, "supplier").withColumn("port", F.col("s_suppkey").cast("int")).join(nations, "s_nationkey")
    return ports.add_port_criticality(rows).groupBy("n_name").agg(
        F.count("*").alias("suppliers"), F.sum("criticality_weight").alias("criticality"))
