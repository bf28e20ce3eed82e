"""Model training, classifier comparison, inference and importance queries."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog import query
from catalog.ctes import FLOW_COLUMNS, with_ctes
from catalog.views import ROW_KEYS, discarded, flows, predictions, scratch, table
from flowintel import dims
from flowintel.operators import evaluate, importance, models, results, sampling, splits, thresholds
from flowintel.operators.splits import TrainingConfig
from flowintel.plans import jobs
from flowintel.sources import files

FOREST = TrainingConfig(
    split_strategy="chronological_per_class", num_trees=10, max_depth=6, row_keys=tuple(ROW_KEYS))


@query("model_evaluation")
def model_evaluation(spark, sf):
    """Forest trained on the train part of all flows, evaluated on validation and test."""
    return jobs.train_and_evaluate(flows(spark, sf), FOREST)["overall"]


@query("model_feature_importance")
def model_feature_importance(spark, sf):
    return jobs.train_and_evaluate(flows(spark, sf), FOREST)["importances"]


@query("classifier_comparison")
def classifier_comparison(spark, sf):
    config = TrainingConfig(split_strategy="chronological_per_class", num_trees=5, use_class_weights=False)
    prepared, features = models.prepare(flows(spark, sf), config)
    return models.compare_classifiers(prepared, features, config)


@query("inferred_aggregates")
def inferred_aggregates(spark, sf):
    """Flows grouped by the predicted label after the threshold policy."""
    df = flows(spark, sf)
    prepared, features = models.prepare(df, FOREST)
    model = models.fit(prepared, features, FOREST)
    return models.infer_labels(model, df, dims.TAU_BY_CLASS).groupBy("label", "inferred_label").agg(
        F.count("*").alias("flow_count"))


_MLLIB = """WITH c AS (SELECT {by}{t} AS t, {p} AS p, count(*) AS n FROM {source} GROUP BY ALL), k AS (
 SELECT {by}x, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(h)::DOUBLE AS h FROM (
  SELECT {by}t AS x, n AS t, 0 AS p, CASE WHEN t=p THEN n ELSE 0 END AS h FROM c UNION ALL SELECT {by}p, 0, n, 0 FROM c) GROUP BY ALL)
 SELECT {by}round(sum(h)/sum(t),6) AS accuracy, round(sum(t*CASE WHEN p=0 THEN 0 ELSE h/p END)/sum(t),6) AS weighted_precision,
 round(sum(h)/sum(t),6) AS weighted_recall, round(sum(t*CASE WHEN t+p=0 THEN 0 ELSE 2*h/(t+p) END)/sum(t),6) AS weighted_f1 FROM k {group}"""


def _rounded(metrics):
    names = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"]
    return metrics.withColumns({n: F.round(n, 6) for n in names})


@query("evaluator_metrics", _MLLIB.format(by="", group="", t="toxic", p="quality", source="labels"))
def evaluator_metrics(spark, sf):
    return _rounded(evaluate.evaluator_metrics(table(spark, sf, "labels"), "toxic", "quality"))


@query("evaluator_metrics_by_split", with_ctes("SELECT * FROM (" + _MLLIB.format(
    by="split, ", group="GROUP BY 1", t="label_idx", p="prediction", source="predictions") + ")", "predictions"))
def evaluator_metrics_by_split(spark, sf):
    return _rounded(evaluate.evaluator_metrics(predictions(spark, sf), by=["split"]))


@query("fit_rows_per_class", with_ctes(
    "SELECT label, count(*) AS rows_seen, least(count(*), 300) AS rows_kept FROM clean GROUP BY 1", "clean"))
def fit_rows_per_class(spark, sf):
    """Rows per class before and after the bound; the rows' keys are unique, so it is met exactly."""
    rows = flows(spark, sf, ROW_KEYS)
    kept = sampling.bottom_k(rows, 300, "label", ROW_KEYS).groupBy("label").agg(F.count("*").alias("rows_kept"))
    return rows.groupBy("label").agg(F.count("*").alias("rows_seen")).join(kept, "label")


_PER_CLASS_PARTS = """tagged AS (SELECT *, CASE WHEN n<=1 THEN 'train' WHEN n=2 THEN CASE WHEN r=1 THEN 'train' ELSE 'test' END
 WHEN r<=k1 THEN 'train' WHEN r<=greatest(k1+1, least(floor(n*0.85::DOUBLE), n-1)) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, greatest(1, least(floor(n*0.70::DOUBLE), n-2)) AS k1 FROM (SELECT *, max(r) OVER (PARTITION BY label) AS n FROM (
 SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY timestamp_parsed) AS r FROM clean))))"""


def _facts(body: str) -> str:
    return with_ctes("", "clean", "classes").rstrip() + f",\n{_PER_CLASS_PARTS}\n{body}"


_KNOWN = "label IN (SELECT class_name FROM classes)"


@query("model_evaluation_facts", _facts(
    "SELECT split, count(*) AS total_evaluated_samples, true AS rates_in_range, true AS recall_is_accuracy, true AS matrix_is_whole"
    f" FROM tagged WHERE split<>'train' AND {_KNOWN} GROUP BY 1"))
def model_evaluation_facts(spark, sf):
    """What SQL can say about a training job, from what it stored: rows judged per part, bounds and identities of its rates,
    and that the stored confusion matrices hold all rows."""
    path = scratch(spark, "model")
    jobs.train_and_evaluate(flows(spark, sf), FOREST, path)
    stored = spark.read.json(f"{path}/evaluation")
    rates = ["overall_accuracy", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]
    inside = F.forall(F.array(*rates), lambda x: (x >= 0) & (x <= 1))
    document = spark.read.json(f"{path}/evaluation_report")
    cells = [results.confusion_rows_from_matrix(document, f"{part}_metrics") for part in ("validation", "test")]
    counted = cells[0].unionByName(cells[1]).groupBy("split").agg(F.sum("raw_count").alias("_cells"))
    return discarded(spark, path, stored.join(counted, "split").select(
        "split", "total_evaluated_samples", inside.alias("rates_in_range"),
        (F.abs(F.col("weighted_recall") - F.col("overall_accuracy")) < 0.001).alias("recall_is_accuracy"),
        (F.col("_cells") == F.col("total_evaluated_samples")).alias("matrix_is_whole")))


@query("classifier_comparison_facts", _facts(
    f"SELECT c AS classifier, count(*) AS total_evaluated_samples, true AS rates_in_range FROM tagged CROSS JOIN (VALUES"
    f" ('decision_tree'), ('logistic_regression'), ('random_forest')) v(c) WHERE split='test' AND {_KNOWN} GROUP BY 1"))
def classifier_comparison_facts(spark, sf):
    config = TrainingConfig(split_strategy="chronological_per_class", num_trees=5, use_class_weights=False)
    prepared, features = models.prepare(flows(spark, sf), config)
    found = models.compare_classifiers(prepared, features, config)
    inside = F.forall(F.array("overall_accuracy", "weighted_precision", "weighted_recall", "weighted_f1"), lambda x: (x >= 0) & (x <= 1))
    return found.select("classifier", "total_evaluated_samples", inside.alias("rates_in_range"))


@query("inferred_aggregates_facts", with_ctes(
    f"SELECT label, count(*) AS flow_count, true AS inferred_known FROM clean WHERE {_KNOWN} GROUP BY 1", "clean", "classes"))
def inferred_aggregates_facts(spark, sf):
    """Every flow of a known label gets one inferred label, one of the classes, from a stored model."""
    df, path = flows(spark, sf), scratch(spark, "model")
    prepared, features = models.prepare(df, FOREST)
    models.fit(prepared, features, FOREST).write().save(path)
    inferred = models.infer_labels(files.read_model(spark, path), df.where(F.col("label").isin(dims.CLASS_LABELS)), dims.TAU_BY_CLASS)
    found = inferred.groupBy("label", "inferred_label").agg(F.count("*").alias("flow_count"))
    return discarded(spark, path, found.groupBy("label").agg(
        F.sum("flow_count").alias("flow_count"), F.bool_and(F.col("inferred_label").isin(dims.CLASS_LABELS)).alias("inferred_known")))


@query("model_importance_facts", "SELECT v.feature_name, true AS ranked_once, true AS own_value, true AS in_range FROM (VALUES " + ", ".join(
    f"('{f}')" for f in models.assembler_inputs(models.feature_columns(FLOW_COLUMNS))) + ") v(feature_name) WHERE (SELECT count(*) FROM lineitem) > 0")
def model_importance_facts(spark, sf):
    """Names, ranks and range of a stored forest's importances, and that its node table gives the model's own values."""
    prepared, features = models.prepare(flows(spark, sf), FOREST)
    model = models.fit(prepared, features, FOREST)
    path = scratch(spark, "model")
    model.write().save(path)
    own = importance.rank_importances(models.forest_importances(model, features), 6)
    computed = importance.tree_importance(files.read_tree_nodes(spark, path), files.read_feature_order(spark, path))
    same = importance.compare_importances(computed, models.forest_importances(model, features), 1e-6).select("feature_name", "matches")
    ranks = own.agg((F.count_distinct("rank") == F.count("*")) & (F.max("rank") == F.count("*"))).scalar()
    return discarded(spark, path, own.join(same, "feature_name", "left").select(
        "feature_name", ranks.alias("ranked_once"), F.coalesce("matches", F.col("importance") == 0).alias("own_value"),
        F.col("importance").between(0, 1).alias("in_range")))


@query("vector_policy",
       "SELECT label AS prediction, CASE WHEN label=3 AND embedding[4]::DOUBLE<0.1::DOUBLE THEN 0.0 ELSE label::DOUBLE END AS adjusted_prediction,"
       " count(*) AS n FROM (SELECT label::DOUBLE AS label, embedding FROM embeddings) GROUP BY 1,2")
def vector_policy(spark, sf):
    """Policy on ML vectors: the embedding takes the place of the probability vector."""
    rows = table(spark, sf, "embeddings").select(
        F.col("label").cast("double").alias("prediction"),
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("probability"))
    return thresholds.apply_threshold_policy(rows, {3: 0.1}).groupBy("prediction", "adjusted_prediction").agg(
        F.count("*").alias("n"))


# tree-node table derived from order lines: 30 trees, 12 features of which two never split
_NODES = """SELECT l_orderkey%30 AS tree, l_partkey%10 AS f, l_discount AS gain,
 l_quantity+l_linenumber AS w FROM lineitem WHERE l_discount>0"""
_TREE_SQL = f"""SELECT i AS training_index, 'feature_' || i AS feature_name, coalesce(round(imp,8),0) AS importance FROM range(12) r(i)
 LEFT JOIN (SELECT f, sum(share)/(SELECT count(DISTINCT tree) FROM n) AS imp FROM (SELECT f, g/sum(g) OVER (PARTITION BY tree) AS share
 FROM (SELECT tree, f, sum(gain*w) AS g FROM n GROUP BY 1,2)) GROUP BY 1) ON f=i"""


def tree_importances(spark, sf):
    line = table(spark, sf, "lineitem")
    nodes = line.select(
        (F.col("l_orderkey") % 30).alias("treeID"),
        F.struct(
            F.col("l_discount").alias("gain"),
            F.struct((F.col("l_partkey") % 10).cast("int").alias("featureIndex")).alias("split"),
            F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("impurityStats"),
        ).alias("nodeData"))
    order = spark.range(12).select(
        F.col("id").cast("int").alias("training_index"), F.concat(F.lit("feature_"), F.col("id").cast("string")).alias("feature_name"))
    return importance.tree_importance(nodes, order)


@query("tree_importance", f"WITH n AS ({_NODES}) SELECT * REPLACE(training_index::INTEGER AS training_index) FROM ({_TREE_SQL})")
def tree_importance(spark, sf):
    return tree_importances(spark, sf).withColumn("importance", F.round("importance", 8))


_RANKED = f"""SELECT feature_name, feature_name AS clean_feature_name, training_index::INTEGER AS training_index, importance,
 CAST(row_number() OVER (ORDER BY importance DESC, training_index) AS INTEGER) AS rank FROM ({_TREE_SQL})"""


@query("importance_ranks", f"WITH n AS ({_NODES}) {_RANKED}")
def importance_ranks(spark, sf):
    return importance.rank_importances(tree_importances(spark, sf))


@query("importance_page", f"WITH n AS ({_NODES}) SELECT feature_name, importance, rank, 'Ranks 6-10' AS rank_range FROM ({_RANKED}) WHERE rank BETWEEN 6 AND 10")
def importance_page(spark, sf):
    ranked = importance.rank_importances(tree_importances(spark, sf))
    return importance.importance_page(ranked, page=2, page_size=5).select(
        "feature_name", "importance", "rank", "rank_range")


@query("importance_checks",
       f"WITH n AS ({_NODES}) SELECT count(*) AS feature_count, 0 AS non_finite, count(*) FILTER (WHERE importance<0) AS negative,"
       f" round(sum(importance),6) AS total, true AS passed FROM ({_TREE_SQL})")
def importance_checks(spark, sf):
    return importance.importance_checks(tree_importances(spark, sf), 12).withColumn("total", F.round("total", 6))


@query("importance_comparison",
       f"WITH n AS ({_NODES}) SELECT feature_name, training_index%4<>0 AS matches FROM ({_TREE_SQL})")
def importance_comparison(spark, sf):
    computed = tree_importances(spark, sf)
    drift = F.when(F.col("training_index") % 4 == 0, 0.01).otherwise(0.0)
    stored = computed.select("feature_name", (F.round("importance", 8) + drift).alias("importance"))
    return importance.compare_importances(computed, stored).select("feature_name", "matches")


@query("saved_model_importance")
def saved_model_importance(spark, sf):
    """Importances recomputed from the node table of a saved forest, next to the model's own."""
    prepared, features = models.prepare(flows(spark, sf), FOREST)
    model = models.fit(prepared, features, FOREST)
    path = scratch(spark, "model")
    model.write().save(path)
    computed = importance.tree_importance(files.read_tree_nodes(spark, path), files.read_feature_order(spark, path))
    return discarded(spark, path, importance.compare_importances(computed, models.forest_importances(model, features), 1e-6))


@query("prepared_parts", with_ctes(
    "SELECT split, count(*) AS total_rows, 0 AS invalid_label_rows, 0 AS null_label_rows FROM by_day WHERE label_idx>=0 GROUP BY 1", "by_day"))
def prepared_parts(spark, sf):
    config = TrainingConfig(split_strategy="inter_day_chronological")
    prepared, _ = models.prepare(flows(spark, sf), config)
    return splits.label_audit(prepared)


_SELECTED = models.feature_columns(FLOW_COLUMNS)


@query("selected_features", with_ctes(" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS values_present FROM clean" for i, c in enumerate(_SELECTED)), "clean"))
def selected_features(spark, sf):
    """Selected model features in input order."""
    df = flows(spark, sf)
    rows = ", ".join(
        f"struct({i} AS position, '{n}' AS feature, count({n}) AS values_present)"
        for i, n in enumerate(models.feature_columns(df.columns)))
    return df.agg(F.expr(f"array({rows})").alias("f")).select(F.inline("f"))
