"""Split, sampling and weighting queries."""

from pyspark.sql import functions as F

from catalog import query
from catalog.ctes import with_ctes
from catalog.views import ROW_KEYS, flows, predictions, table
from flowintel.functions.labels import add_label_index
from flowintel.operators import clean, models, splits
from flowintel.operators.distribution import rows_in

_R, _RV = 0.70, 0.70 + 0.15


def _k(n: str) -> tuple[str, str]:
    k1 = f"greatest(1, least(floor({n}*{_R!r}::DOUBLE), {n}-2))"
    return k1, f"greatest({k1}+1, least(floor({n}*{_RV!r}::DOUBLE), {n}-1))"


def _tag(rank: str, n: str) -> str:
    k1, k2 = _k(n)
    return (f"CASE WHEN {n}<=1 THEN 'train' WHEN {n}=2 THEN CASE WHEN {rank}=1 THEN 'train' ELSE 'test' END"
            f" WHEN {rank}<={k1} THEN 'train' WHEN {rank}<={k2} THEN 'val' ELSE 'test' END")


_GLOBAL = f"""SELECT c.*, {_tag('r', 'n')} AS split FROM clean c JOIN (SELECT timestamp_parsed AS ts, r, max(r) OVER () AS n FROM (
 SELECT timestamp_parsed, dense_rank() OVER (ORDER BY timestamp_parsed) AS r FROM (SELECT DISTINCT timestamp_parsed FROM clean)))
 ON c.timestamp_parsed=ts"""
_PER_CLASS = f"""SELECT *, {_tag('r', 'n')} AS split FROM (SELECT *, max(r) OVER (PARTITION BY label) AS n FROM (
 SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY timestamp_parsed) AS r FROM clean))"""


def _counts(df, weight=None):
    return df.groupBy("label", "split").agg(
        rows_in(weight).alias("flow_count"),
        F.date_format(F.min("timestamp_parsed"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format(F.max("timestamp_parsed"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


_COUNTS = """SELECT label, split, count(*) AS flow_count, strftime(min(timestamp_parsed),'%Y-%m-%d %H:%M:%S') AS first_seen,
 strftime(max(timestamp_parsed),'%Y-%m-%d %H:%M:%S') AS last_seen FROM ({src}) GROUP BY 1,2"""


@query("split_global", with_ctes(_COUNTS.format(src=_GLOBAL), "clean"))
def split_global(spark, sf):
    return _counts(splits.split_global(splits.timestamp_cells(flows(spark, sf))), "flow_count")


@query("split_per_class", with_ctes(_COUNTS.format(src=_PER_CLASS), "clean"))
def split_per_class(spark, sf):
    return _counts(splits.split_per_class(splits.timestamp_cells(flows(spark, sf))), "flow_count")


@query("split_inter_day", with_ctes(_COUNTS.format(src="SELECT * FROM by_day"), "by_day"))
def split_inter_day(spark, sf):
    return _counts(splits.split_inter_day(flows(spark, sf)))


_HASH = ("(CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, '42')),1,8) AS BIGINT) % {b})")
_HASHED = f"""SELECT *, CASE WHEN {_HASH.format(b=100)}<70 THEN 'train' WHEN {_HASH.format(b=100)}<85 THEN 'val' ELSE 'test' END AS split FROM clean"""


@query("split_hashed", with_ctes(_COUNTS.format(src=_HASHED), "clean"))
def split_hashed(spark, sf):
    return _counts(splits.split_hashed(flows(spark, sf, ROW_KEYS), ROW_KEYS))


@query("event_split_global",
       f"SELECT event_type, split, count(*) AS n FROM (SELECT e.*, {_tag('r', 'm')} AS split FROM events e JOIN ("
       "SELECT ts AS t, r, max(r) OVER () AS m FROM (SELECT ts, dense_rank() OVER (ORDER BY ts) AS r FROM (SELECT DISTINCT ts FROM events)))"
       " ON e.ts=t) GROUP BY 1,2")
def event_split_global(spark, sf):
    tagged = splits.split_global(table(spark, sf, "events"), ts_col="ts")
    return tagged.groupBy("event_type", "split").agg(F.count("*").alias("n"))


@query("order_split_per_class",
       f"SELECT o_orderpriority, split, count(*) AS n FROM (SELECT *, {_tag('r', 'm')} AS split FROM (SELECT *,"
       " max(r) OVER (PARTITION BY o_orderpriority) AS m FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate)"
       " AS r FROM orders))) GROUP BY 1,2")
def order_split_per_class(spark, sf):
    tagged = splits.split_per_class(table(spark, sf, "orders"), ts_col="o_orderdate", label_col="o_orderpriority")
    return tagged.groupBy("o_orderpriority", "split").agg(F.count("*").alias("n"))


@query("distinct_timestamps", with_ctes(
    "SELECT event_date::VARCHAR AS event_date, count(DISTINCT timestamp_parsed) AS stamps FROM clean GROUP BY 1", "clean"))
def distinct_timestamps(spark, sf):
    return splits.distinct_timestamps(flows(spark, sf)).groupBy(
        F.to_date("timestamp_parsed").cast("string").alias("event_date")).agg(F.count("*").alias("stamps"))


@query("timestamp_ranks",
       "SELECT strftime(ts,'%Y-%m-%d %H:%M:%S.%f') AS ts, dense_rank() OVER (ORDER BY e.ts) AS d_rank,"
       " count(*) OVER () AS distinct_count FROM (SELECT DISTINCT ts FROM events) e")
def timestamp_ranks(spark, sf):
    return splits.timestamp_ranks(table(spark, sf, "events"), "ts").withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("label_timestamp_ranks", with_ctes(
    "SELECT label, strftime(timestamp_parsed,'%Y-%m-%d %H:%M:%S') AS timestamp_parsed,"
    " dense_rank() OVER (PARTITION BY label ORDER BY c.timestamp_parsed) AS d_rank, count(*) OVER (PARTITION BY label) AS distinct_count"
    " FROM (SELECT DISTINCT label, timestamp_parsed FROM clean) c", "clean"))
def label_timestamp_ranks(spark, sf):
    return splits.timestamp_ranks(flows(spark, sf), by=["label"]).withColumn(
        "timestamp_parsed", F.date_format("timestamp_parsed", "yyyy-MM-dd HH:mm:ss"))


_COVERAGE = """SELECT class_name, train_support, val_support, test_support, train_support=0 AS zero_train_support,
 test_support=0 AS zero_test_support, CASE WHEN train_support>0 AND val_support>0 AND test_support>0 THEN 'full_span'
 WHEN train_support>0 AND val_support=0 AND test_support=0 THEN 'train_only'
 WHEN train_support=0 AND val_support=0 AND test_support>0 THEN 'test_only'
 WHEN train_support=0 AND val_support>0 AND test_support=0 THEN 'val_only'
 WHEN train_support+val_support+test_support>0 THEN 'partial_span' ELSE 'zero_dataset_support' END AS temporal_coverage FROM (
 SELECT k.class_name, count(*) FILTER (WHERE split='train') AS train_support, count(*) FILTER (WHERE split='val') AS val_support,
 count(*) FILTER (WHERE split='test') AS test_support FROM classes k LEFT JOIN ({src}) s ON s.label=k.class_name GROUP BY 1)"""


@query("split_coverage", with_ctes(_COVERAGE.format(src=_GLOBAL), "clean", "classes"))
def split_coverage(spark, sf):
    return splits.split_coverage(splits.split_global(splits.timestamp_cells(flows(spark, sf))), weight="flow_count")


@query("split_verification", with_ctes(
    "SELECT split, count(*) AS total_rows, count(*)-CASE split WHEN 'val' THEN 1 ELSE 0 END AS expected_rows, split<>'val' AS split_match,"
    " (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT split AS s, label, count(*) AS n FROM by_day GROUP BY 1,2) c"
    " WHERE c.s=b.split) AS class_counts FROM by_day b GROUP BY 1", "by_day"))
def split_verification(spark, sf):
    tagged = splits.split_inter_day(flows(spark, sf))
    off_by_one = F.when(F.col("split") == "val", 1).otherwise(0)
    expected = splits.split_totals(tagged).select("split", (F.col("total_rows") - off_by_one).alias("expected_rows"))
    text = F.transform(F.map_entries("class_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return splits.verify_split(tagged, expected).withColumn("class_counts", F.array_join(text, ","))


@query("split_overlap", with_ctes(
    f"SELECT count(*) AS shared_timestamps FROM (SELECT timestamp_parsed FROM ({_GLOBAL}) GROUP BY 1 HAVING count(DISTINCT split)>1)", "clean"))
def split_overlap(spark, sf):
    return splits.overlap(splits.split_global(splits.timestamp_cells(flows(spark, sf)))).agg(F.count("*").alias("shared_timestamps"))


@query("split_date_counts", with_ctes(
    "SELECT split, event_date::VARCHAR AS event_date, count(*) AS all_rows, count(*) FILTER (WHERE label='Benign') AS benign_rows,"
    f" count(*) FILTER (WHERE label='Infiltration') AS focus_rows FROM ({_PER_CLASS}) GROUP BY 1,2", "clean"))
def split_date_counts(spark, sf):
    return splits.split_date_counts(splits.split_per_class(flows(spark, sf))).withColumn(
        "event_date", F.col("event_date").cast("string"))


@query("label_index", with_ctes("SELECT label, label_idx, count(*) AS flow_count FROM indexed GROUP BY 1,2", "indexed"))
def label_index(spark, sf):
    return add_label_index(flows(spark, sf)).groupBy("label", "label_idx").agg(F.count("*").alias("flow_count"))


@query("label_audit", with_ctes(
    "SELECT split, count(*) AS total_rows, count(*) FILTER (WHERE label_idx=-1) AS invalid_label_rows,"
    " count(*) FILTER (WHERE label_idx IS NULL) AS null_label_rows FROM by_day GROUP BY 1", "by_day"))
def label_audit(spark, sf):
    return splits.label_audit(splits.split_inter_day(add_label_index(flows(spark, sf))))


_WEIGHTS = """SELECT label, class_count, round(least(sum(class_count) OVER ()::DOUBLE/(count(*) OVER ()*class_count), 500.0),4) AS weight
 FROM (SELECT label, count(*) AS class_count FROM by_day WHERE split='train' GROUP BY 1)"""


@query("class_weights", with_ctes(_WEIGHTS, "by_day"))
def class_weights(spark, sf):
    return splits.class_weights(splits.split_inter_day(flows(spark, sf)).where(F.col("split") == "train"))


@query("weighted_rows", with_ctes(
    f"SELECT split, b.label, CASE WHEN split='train' THEN w.weight ELSE 1.0 END AS weight, count(*) AS flow_count"
    f" FROM by_day b LEFT JOIN ({_WEIGHTS}) w ON b.label=w.label GROUP BY 1,2,3", "by_day"))
def weighted_rows(spark, sf):
    train, val, test = splits.parts(splits.split_inter_day(flows(spark, sf)))
    weighted = splits.add_class_weights(train, splits.class_weights(train))
    neutral = splits.add_neutral_weight(val.unionByName(test))
    return weighted.unionByName(neutral).groupBy("split", "label", "weight").agg(F.count("*").alias("flow_count"))


@query("order_status_weights",
       "SELECT o_orderstatus, class_count, round(least(sum(class_count) OVER ()::DOUBLE/(count(*) OVER ()*class_count), 500.0),4) AS weight"
       " FROM (SELECT o_orderstatus, count(*) AS class_count FROM orders GROUP BY 1)")
def order_status_weights(spark, sf):
    return splits.class_weights(table(spark, sf, "orders"), label_col="o_orderstatus")


_DRAW = _HASH.format(b=1000000) + "/1000000.0::DOUBLE"
_SAMPLED = f"""SELECT c.*, n<=500 AS is_rare, n<=500 OR {_DRAW}<0.2 AS sampled FROM clean c
 JOIN (SELECT label AS l, count(*) AS n FROM clean GROUP BY 1) ON label=l"""


@query("sampled_stratified", with_ctes(
    f"SELECT label, count(*) AS pre_sample_count, count(*) FILTER (WHERE sampled) AS post_sample_count, count(*)<=500 AS is_protected"
    f" FROM ({_SAMPLED}) GROUP BY 1", "clean"))
def sampled_stratified(spark, sf):
    return splits.sampling_by_class(splits.tag_sample(flows(spark, sf, ROW_KEYS), 0.2, keys=ROW_KEYS))


@query("sampled_uniform", with_ctes(
    f"SELECT label, count(*) AS flow_count FROM clean WHERE {_DRAW}<0.2 GROUP BY 1", "clean"))
def sampled_uniform(spark, sf):
    rows = splits.subsample(flows(spark, sf, ROW_KEYS), 0.2, strategy="uniform_random", keys=ROW_KEYS)
    return rows.groupBy("label").agg(F.count("*").alias("flow_count"))


@query("sampling_summary", with_ctes(
    "SELECT count(*) AS total_pre_sampling, count(*) FILTER (WHERE sampled) AS total_post_sampling,"
    " round(count(*) FILTER (WHERE sampled)::DOUBLE/count(*),6) AS effective_subsample_ratio,"
    " CAST(floor(count(*)*0.2::DOUBLE) AS BIGINT) AS expected_rows_unprotected,"
    " greatest(0, count(*) FILTER (WHERE sampled)-CAST(floor(count(*)*0.2::DOUBLE) AS BIGINT)) AS excess_rows_from_protection,"
    f" count(DISTINCT label) FILTER (WHERE is_rare) AS protected_classes FROM ({_SAMPLED})", "clean"))
def sampling_summary(spark, sf):
    tagged = splits.tag_sample(flows(spark, sf, ROW_KEYS), 0.2, keys=ROW_KEYS)
    return splits.sampling_summary(splits.sampling_by_class(tagged), 0.2)


_FEATURES = ["flow_duration", "tot_fwd_pkts", "flow_byts_s", "down_up_ratio"]


@query("sanitized_features", with_ctes(" UNION ALL ".join(
    f"SELECT split, '{c}' AS feature, count(*) FILTER (WHERE v IS NULL OR isnan(v) OR isinf(v)) AS null_count, 0 AS non_finite_count FROM"
    f" (SELECT CASE WHEN l_linenumber%3=0 THEN 'train' WHEN l_linenumber%3=1 THEN 'val' ELSE 'test' END AS split, TRY_CAST({c} AS DOUBLE) AS v"
    " FROM raw WHERE label<>'Label') GROUP BY 1" for c in _FEATURES), "raw"))
def sanitized_features(spark, sf):
    from catalog.views import raw_flows

    rows = clean.rename_columns(clean.without_repeated_headers(raw_flows(spark, sf, ["l_linenumber"])))
    part = F.col("l_linenumber") % 3
    split = F.when(part == 0, "train").when(part == 1, "val").otherwise("test")
    typed = rows.select(split.alias("split"), *[F.col(c).try_cast("double").alias(c) for c in _FEATURES])
    return clean.feature_quality(models.sanitize_features(typed, _FEATURES), _FEATURES, "split")


@query("split_set_differences", with_ctes(
    "SELECT (SELECT count(*) FROM (SELECT label FROM by_day WHERE split='train' INTERSECT SELECT label FROM by_day WHERE split='test')) AS shared_labels,"
    " (SELECT count(*) FROM (SELECT label FROM by_day WHERE split='train' EXCEPT SELECT label FROM by_day WHERE split='val')) AS train_only_labels", "by_day"))
def split_set_differences(spark, sf):
    # set operations join whole rows before they drop copies, so copies go first: a frequent label is one row of a join, not one task
    train, val, test = (p.select("label").distinct() for p in splits.parts(predictions(spark, sf)))
    return spark.range(1).select(
        train.intersect(test).agg(F.count("*")).scalar().alias("shared_labels"),
        train.subtract(val).agg(F.count("*")).scalar().alias("train_only_labels"))
