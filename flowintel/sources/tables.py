"""Result tables on Parquet: loading a run all-or-nothing, reading by key.

A load writes its children below a fresh `load_id` and then replaces the one row of the
run in `pipeline_runs`.  Readers follow the load named there, so a run switches from the
old to the new content in one step and a failed load stays invisible.  While a load is being written, an
empty file named after it in `_loading` keeps retention away from its folders.
"""

from __future__ import annotations

import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel.operators import report
from flowintel.operators.results import CHILD_TABLES, RUN_KEY, invalid_profiles
from flowintel.sources.files import path_exists

LOAD_KEY = "load_id"
LOADING = "_loading"
IF_EXISTS = ("replace", "skip", "error")
# Estimated bytes of rows that are shuffled for the sake of few files.  The estimate starts from compressed files, and a
# shuffle of flows takes about five times as much.
REBALANCED_BYTES = 256 << 20


class DuplicateRunError(Exception):
    """The run is already stored and if_exists='error'."""


class ReportPersistenceError(Exception):
    """The report cannot be stored."""


def _partition_key(col: str) -> Column:
    # the prefix keeps Spark from reading a digits-only key back as a number
    return F.concat(F.lit("key-"), F.col(col))


def _write(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions of the rows in `df`; the key columns stay in the files as well."""
    parts = {f"{k}_part": _partition_key(k) for k in keys}
    df.withColumns(parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *parts).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.drop(*[c for c in rows.columns if c.endswith("_part")])


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/pipeline_runs")


def read_table(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """Current rows of a result table; `run_id` prunes the scan to the partition of one run."""
    current = read_runs(spark, root)
    if run_id is not None:
        current = current.where(F.col(RUN_KEY) == run_id)
    if name == "pipeline_runs":
        return current.drop(LOAD_KEY)
    rows = spark.read.parquet(f"{root}/{name}")
    if run_id is not None:
        rows = rows.where(F.col(f"{RUN_KEY}_part") == f"key-{run_id}")
    kept = [c for c in rows.columns if not c.endswith("_part")]
    return rows.select(kept).join(current.select(RUN_KEY, LOAD_KEY), [RUN_KEY, LOAD_KEY], "left_semi").drop(LOAD_KEY)


def read_analytical(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _read(spark, f"{root}/{name}")


def run_is_stored(spark: SparkSession, root: str, run_id: str) -> bool:
    if not path_exists(spark, f"{root}/pipeline_runs"):
        return False
    return not read_runs(spark, root).where(F.col(RUN_KEY) == run_id).isEmpty()


def _path(spark: SparkSession, path: str) -> tuple:
    """File system and path as Spark's own store classes see them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through Spark's own file systems."""
    store, found = _path(spark, path)
    store.delete(found, True)


def loads_in_progress(spark: SparkSession, root: str, abandoned_hours: float) -> list[str]:
    """Ids of the marked loads; marks older than `abandoned_hours` are left by loads that died."""
    store, folder = _path(spark, f"{root}/{LOADING}")
    if not store.exists(folder):
        return []
    oldest = (time.time() - abandoned_hours * 3600) * 1000
    return [f.getPath().getName() for f in store.listStatus(folder) if f.getModificationTime() >= oldest]


def remove_folder(spark: SparkSession, table: str, run_key: str, load_id: str) -> None:
    """Remove one load of a table, given the run's key as its folder shows it in a URI, and the run's folder once it is empty."""
    store, run = _path(spark, f"{table}/{RUN_KEY}_part=key-{unquote(run_key)}")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store.delete(jvm_path(run, f"{LOAD_KEY}_part=key-{load_id}"), True)
    if store.exists(run) and not store.listStatus(run):
        store.delete(run, False)


def load_report(
    spark: SparkSession, root: str, profiles: DataFrame, tables: dict[str, DataFrame], run_id: str,
    if_exists: str = "replace",
) -> str:
    """Store the five tables of one run; returns stored, replaced or skipped."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"if_exists must be one of {IF_EXISTS}")
    if not run_id:
        raise ReportPersistenceError("report is missing a run_id")
    exists = run_is_stored(spark, root, run_id)
    if exists and if_exists == "skip":
        return "skipped"
    if exists and if_exists == "error":
        raise DuplicateRunError(f"run '{run_id}' is already stored")
    if not invalid_profiles(profiles).isEmpty():
        raise ReportPersistenceError("profile without snapshot_id or profile_id")
    foreign = tables["threat_profiles"].where(F.col(RUN_KEY) != run_id)
    if not foreign.isEmpty():
        raise ReportPersistenceError(f"profiles of another run in the report of '{run_id}'")
    load_id = uuid.uuid4().hex
    store, mark = _path(spark, f"{root}/{LOADING}/{load_id}")
    store.create(mark).close()
    try:
        for name in CHILD_TABLES:
            _write(tables[name].withColumn(LOAD_KEY, F.lit(load_id)), f"{root}/{name}", [RUN_KEY, LOAD_KEY])
        _write(tables["pipeline_runs"].withColumn(LOAD_KEY, F.lit(load_id)), f"{root}/pipeline_runs", [RUN_KEY])
    finally:
        store.delete(mark, False)
    return "replaced" if exists else "stored"


def load_analytical(root: str, cells: DataFrame, ports: DataFrame) -> None:
    """Store confusion cells and port rows; the same source hash replaces its earlier rows only."""
    _write(cells, f"{root}/analytical_confusion_matrix", ["source_report_hash"])
    _write(ports, f"{root}/analytical_port_concentration", ["source_report_hash"])


def estimated_bytes(df: DataFrame) -> int:
    """Size of the rows as Spark's optimizer estimates it, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write_curated(
    df: DataFrame, path: str, date_col: str = "event_date", rebalance: bool = False, append: bool = False,
) -> None:
    """Curated flows partitioned by date, in place of those stored there or, with `append`, beside them.

    Capture files hold one day each, so tasks already write few files and no shuffle is
    needed.  For input that mixes dates set `rebalance`: rows are then grouped by date and
    a busy date is split into several evenly sized files.  Where the rows are many, their shuffle would take several
    times the disk of the files; each task then writes one file for each of its dates, which are large enough.
    """
    rows = df.hint("rebalance", F.col(date_col)) if rebalance and estimated_bytes(df) <= REBALANCED_BYTES else df
    rows.write.mode("append" if append else "overwrite").option("compression", "zstd").partitionBy(date_col).parquet(path)


def write_json_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Report as one JSON-lines folder per section."""
    for name, section in sections.items():
        section.write.mode("overwrite").json(f"{path}/{name}")


def write_report(path: str, run: DataFrame, profiles: DataFrame) -> None:
    """The report document as a folder: one header line, the profiles as lines beside it."""
    report.header_lines(run).write.mode("overwrite").text(f"{path}/header")
    report.profile_lines(profiles).write.mode("overwrite").text(f"{path}/profiles")


def write_single_report(path: str, run: DataFrame, profiles: DataFrame) -> None:
    """The report as one JSON document in one file of the folder."""
    report.single_document(run, profiles).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """pipeline_runs row and profiles of a stored report: a folder by write_report(), or one document (file or folder)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"report not found at {path}")
    if path_exists(spark, f"{path}/header"):
        return report.parsed_headers(spark.read.text(f"{path}/header")), report.parsed_profiles(spark.read.text(f"{path}/profiles"))
    document = spark.read.option("wholetext", True).text(path)
    return report.parsed_headers(document), report.document_profiles(document)
