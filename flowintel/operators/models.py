"""Feature selection, MLlib pipelines, training and inference."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, ImputerModel, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.labels import add_label_index, index_to_label
from flowintel.functions.numeric import non_finite_to_null
from flowintel.operators import evaluate, sampling, splits, thresholds
from flowintel.operators.importance import rank_importances
from flowintel.operators.splits import TrainingConfig
from flowintel.session import checkpointed, stored

CATEGORICAL = "protocol"
IMPUTED_SUFFIX = "__imp"


def feature_columns(columns: list[str], config: TrainingConfig | None = None) -> list[str]:
    """Input order without metadata, constants, the port shortcut and pruned duplicates."""
    config = config or TrainingConfig()
    excluded = {*dims.METADATA_COLUMNS, *dims.CONSTANT_COLUMNS}
    if not config.include_dst_port:
        excluded.update(dims.SHORTCUT_COLUMNS)
    if config.prune_collinear_subflows:
        excluded.update(dims.COLLINEAR_COLUMNS)
    return [c for c in columns if c not in excluded]


def sanitize_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Non-finite feature values to null, in one projection; the categorical column stays."""
    numeric = set(features) - {CATEGORICAL}
    return df.selectExpr(*[
        f"{non_finite_to_null(c)} AS {c}" if c in numeric else c for c in df.columns])


def assembler_inputs(features: list[str]) -> list[str]:
    """Feature vector order: imputed numeric columns, then the indexed protocol."""
    inputs = [f"{c}{IMPUTED_SUFFIX}" for c in features if c != CATEGORICAL]
    return inputs + ([f"{CATEGORICAL}_idx"] if CATEGORICAL in features else [])


def preprocessing_stages(features: list[str]) -> list:
    numeric = [c for c in features if c != CATEGORICAL]
    stages = [Imputer(
        strategy="median", inputCols=numeric, outputCols=[f"{c}{IMPUTED_SUFFIX}" for c in numeric])]
    if CATEGORICAL in features:
        stages.append(StringIndexer(
            inputCol=CATEGORICAL, outputCol=f"{CATEGORICAL}_idx", handleInvalid="keep"))
    stages.append(VectorAssembler(
        inputCols=assembler_inputs(features), outputCol="features", handleInvalid="error"))
    return stages


def random_forest(config: TrainingConfig) -> RandomForestClassifier:
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_idx", numTrees=config.num_trees, maxDepth=config.max_depth,
        maxBins=config.max_bins, seed=config.seed)
    return forest.setWeightCol("weight") if config.use_class_weights else forest


def build_training_pipeline(features: list[str], config: TrainingConfig) -> Pipeline:
    return Pipeline(stages=[*preprocessing_stages(features), random_forest(config)])


def comparison_classifiers(config: TrainingConfig) -> dict:
    """The three classifiers that are compared on the same prepared splits."""
    common = {"featuresCol": "features", "labelCol": "label_idx"}
    return {
        "decision_tree": DecisionTreeClassifier(maxDepth=10, maxBins=config.max_bins, seed=config.seed, **common),
        "logistic_regression": LogisticRegression(maxIter=100, regParam=0.01, family="multinomial", **common),
        "random_forest": RandomForestClassifier(
            numTrees=config.num_trees, maxDepth=10, maxBins=config.max_bins, seed=config.seed, **common),
    }


def tag_training_sample(df: DataFrame, config: TrainingConfig) -> DataFrame:
    """Input plus `_sampled` by the sampling settings of the configuration."""
    return splits.tag_sample(
        df, config.subsample_ratio, strategy=config.subsample_strategy, protect_rare=config.protect_rare_classes,
        min_rare=config.min_rare_class_samples, seed=config.seed, keys=list(config.row_keys) or None)


def prepare(df: DataFrame, config: TrainingConfig) -> tuple[DataFrame, list[str]]:
    """Sampled, indexed, sanitized and split rows with only the columns a model needs.

    Rows of an unknown class have no index and cannot be learned, so they are left out.
    """
    sampled = tag_training_sample(df, config).where("_sampled").drop("_sampled")
    features = feature_columns(df.columns, config)
    tagged = splits.split_dataset(sampled, config)
    needed = [c for c in ("label", "event_date") if c in df.columns]
    narrow = tagged.select(*needed, "split", *features)
    indexed = add_label_index(narrow).where(F.col("label_idx") >= 0)
    return sanitize_features(indexed, features), features


def fit_rows(prepared: DataFrame, config: TrainingConfig) -> DataFrame:
    """Stored training rows with weights: all of them or, where `fit_rows_per_class` is set, at most so many of each class,
    the ones with the smallest hashes.

    Imputer, indexer and classifiers read them repeatedly, so they are stored once, compressed and by column.
    """
    train = prepared.where(F.col("split") == "train")
    if config.fit_rows_per_class is not None:
        train = sampling.bottom_k(train, config.fit_rows_per_class, "label_idx", seed=config.seed)
    train = stored(train)
    if config.use_class_weights:
        train = splits.add_class_weights(train, splits.class_weights(train, config.max_class_weight))
    return train


def fit(prepared: DataFrame, features: list[str], config: TrainingConfig, rows: DataFrame | None = None) -> PipelineModel:
    """Model fitted on fit_rows(), or on `rows` where the caller has them already."""
    return build_training_pipeline(features, config).fit(fit_rows(prepared, config) if rows is None else rows)


def predict(model: PipelineModel, df: DataFrame, config: TrainingConfig) -> DataFrame:
    """Predictions with `adjusted_prediction`, which equals `prediction` when the policy is off."""
    scored = model.transform(df)
    return thresholds.apply_threshold_policy(scored, config.taus if config.apply_threshold_policy else {})


def infer_labels(
    model: PipelineModel, df: DataFrame, taus: dict[int, float] | None = None, output_col: str = "inferred_label",
) -> DataFrame:
    """Batch inference; without `taus` the raw prediction is used.  Features are sanitized as in training."""
    features = [c for stage in model.stages if isinstance(stage, ImputerModel) for c in stage.getInputCols()]
    scored = model.transform(sanitize_features(df, features))
    if taus is None:
        return scored.withColumn(output_col, index_to_label(F.col("prediction")))
    adjusted = thresholds.apply_threshold_policy(scored, taus)
    return adjusted.withColumn(output_col, index_to_label(F.col("adjusted_prediction")))


def forest_importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """feature_name, training_index, importance of the fitted forest."""
    importances = model.stages[-1].featureImportances
    names = assembler_inputs(features)
    rows = [(name, i, float(importances[i])) for i, name in enumerate(names)]
    return SparkSession.active().createDataFrame(
        rows, "feature_name string, training_index int, importance double")


def compare_classifiers(prepared: DataFrame, features: list[str], config: TrainingConfig) -> DataFrame:
    """One row per classifier: MLlib metrics and macro / security metrics on the test part.

    All classifiers are fitted on the same stored rows and score the test rows in one scan, which leaves only counts.
    """
    train = fit_rows(prepared, config)
    stages = Pipeline(stages=preprocessing_stages(features)).fit(train)
    ready = stored(stages.transform(train).select("label_idx", "features"))
    scored = stages.transform(prepared.where(F.col("split") == "test")).select("label_idx", "features")
    classifiers = comparison_classifiers(config)
    for name, classifier in classifiers.items():
        model = classifier.fit(ready)
        for column in ("prediction", "rawPrediction", "probability"):
            model.set(model.getParam(f"{column}Col"), f"{name}_{column}")
        scored = model.transform(scored)
    predicted = [f"{name}_prediction" for name in classifiers]
    counts = checkpointed(scored.groupBy("label_idx", *predicted).agg(F.count("*").alias("n")))
    result = None
    for name in classifiers:
        cells = evaluate.contingency(counts, prediction_col=f"{name}_prediction", weight="n")
        overall = evaluate.overall_metrics(evaluate.class_metrics(cells)).select(
            "total_evaluated_samples", "overall_accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
            F.lit(name).alias("classifier"))
        row = overall.join(evaluate.macro_metrics(cells).withColumn("classifier", F.lit(name)), "classifier")
        result = row if result is None else result.unionByName(row)
    return result


def save_model(
    model: PipelineModel, features: list[str], config: TrainingConfig, coverage: DataFrame, evaluation: DataFrame,
    model_dir: str, extra: dict[str, DataFrame] | None = None,
) -> None:
    """Model plus feature order, class map, configuration, split coverage, evaluation and `extra` tables as JSON next to it."""
    spark = evaluation.sparkSession
    model.write().overwrite().save(f"{model_dir}/model")
    settings = {k: str(v) for k, v in vars(config).items()}
    ranked = rank_importances(forest_importances(model, features), 6)
    tables = {
        "feature_metadata": ranked,
        "top_10_feature_importances": ranked.where(F.col("rank") <= 10),
        "label_mapping": dims.classes(spark),
        "training_config": spark.createDataFrame(list(settings.items()), "parameter string, value string"),
        "split_summary": coverage,
        "evaluation": evaluation,
        **(extra or {}),
    }
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{model_dir}/{name}")
