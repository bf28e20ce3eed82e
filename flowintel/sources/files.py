"""Scans: raw CSV, curated Parquet, JSON reports, fitted models, storage listings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowintel import dims


def raw_schema() -> T.StructType:
    """All 80 columns as strings, so bad tokens survive until they are audited."""
    return T.StructType([T.StructField(name, T.StringType(), True) for name in dims.RAW_COLUMNS])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Spark's own file systems, so it also holds for remote storage."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def qualified(spark: SparkSession, path: str) -> str:
    """Full URI of a path, as Spark names the files below it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()


def selected_files(spark: SparkSession, raw_dir: str, files: list[str]) -> tuple[list[str], list[str]]:
    """Those of the named members of a folder that exist, and those that do not."""
    found = {name: path_exists(spark, f"{raw_dir.rstrip('/')}/{name}") for name in files}
    return [n for n in files if found[n]], [n for n in files if not found[n]]


def read_raw_flows(spark: SparkSession, raw_dir: str, files: list[str] | None = None) -> DataFrame:
    """Raw CSV files with a `source_file` lineage column.

    `files` names members of `raw_dir`; missing ones are skipped (selected_files() names them), none at all is an error.
    Without `files` the whole folder is read.
    """
    if files is None:
        paths = [raw_dir] if path_exists(spark, raw_dir) else []
    else:
        paths = [f"{raw_dir.rstrip('/')}/{name}" for name in selected_files(spark, raw_dir, files)[0]]
    if not paths:
        raise FileNotFoundError(f"no selected raw files in {raw_dir}")
    return (
        spark.read.schema(raw_schema())
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .csv(paths)
        .select("*", F.col("_metadata.file_name").alias("source_file"))
    )


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"curated dataset not found at {path}")
    return spark.read.parquet(path)


def storage_layout(spark: SparkSession, path: str, partition_col: str = "event_date") -> DataFrame:
    """Files and bytes per partition, from the file listing only: no data file is opened."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return (
        listing.groupBy(F.col(partition_col).cast("string").alias(partition_col))
        .agg(F.count("*").alias("files_count"), F.sum("length").alias("total_bytes"))
        .withColumn("total_mb", F.round(F.col("total_bytes") / (1024 * 1024), 2))
    )


def read_json_report(spark: SparkSession, locations: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """First existing location of a one-document JSON report."""
    found = next((p for p in locations if path_exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"report not found, searched {locations}")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(found)


def report_section(report: DataFrame, section: str) -> DataFrame:
    """One section of a report; an absent or null section is an error, not an empty result."""
    try:
        part = report.select(F.col(section))
    except AnalysisException as missing:
        raise ValueError(f"report has no section '{section}'") from missing
    present = F.assert_true(F.col(section).isNotNull(), F.lit(f"report has no section '{section}'"))
    return part.where(present.isNull())


def read_model(spark: SparkSession, path: str) -> PipelineModel:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"model not found at {path}")
    return PipelineModel.load(path)


def read_tree_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """Node table of the tree-ensemble stage of a saved pipeline."""
    return spark.read.parquet(f"{model_path}/stages/*_*Forest*/data")


def read_feature_order(spark: SparkSession, model_path: str) -> DataFrame:
    """training_index, feature_name in assembler input order."""
    meta = spark.read.json(f"{model_path}/stages/*_VectorAssembler_*/metadata")
    return meta.select(F.posexplode("paramMap.inputCols").alias("training_index", "feature_name"))
