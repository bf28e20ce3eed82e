"""Removal of loads that no current run refers to.

Replaced and failed loads leave their folders behind.  A load is superseded when its id is not that of
a current run.  Its age counts from the moment it went out of use: from the commit of the run row that
replaced it, or from its last file where no run row exists.  So readers that began before a replacement have
`min_age_hours` to end.  Loads in progress are marked (sources.tables) and left alone; a mark older
than `abandoned_hours` belongs to a load that died and no longer counts.

The order of reading makes this safe: folders are listed first, then the marks, then the current
runs.  A load that commits meanwhile is found as current, one that starts later is not in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel.operators.results import CHILD_TABLES
from flowintel.session import checkpointed
from flowintel.sources import tables
from flowintel.sources.files import path_exists

MIN_AGE_HOURS = 7 * 24.0
ABANDONED_HOURS = 7 * 24.0


def _listing(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """_path, _changed, _bytes of files from the listing only; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("_path"), F.col("modificationTime").alias("_changed"), F.col("length").alias("_bytes"))


def _part(name: str) -> Column:
    """The key in the partition folder of a path, as it is written there."""
    return F.regexp_extract("_path", rf"/{name}_part=key-([^/]+)/", 1)


def load_folders(spark: SparkSession, root: str) -> DataFrame:
    """table_name, run_key, load_id, files, bytes, last_change of every load folder of the child tables."""
    found = None
    for name in CHILD_TABLES:
        if path_exists(spark, f"{root}/{name}"):
            files = _listing(spark, f"{root}/{name}", "*.parquet").select(
                F.lit(name).alias("table_name"), _part("run_id").alias("run_key"), _part("load_id").alias("load_id"), "_changed", "_bytes")
            found = files if found is None else found.unionByName(files)
    if found is None:
        return spark.createDataFrame([], "table_name string, run_key string, load_id string, files bigint, bytes bigint, last_change timestamp")
    return found.groupBy("table_name", "run_key", "load_id").agg(
        F.count("*").alias("files"), F.sum("_bytes").alias("bytes"), F.max("_changed").alias("last_change"))


def superseded_loads(spark: SparkSession, root: str, abandoned_hours: float = ABANDONED_HOURS) -> DataFrame:
    """Load folders without a current run: those of load_folders() with unused_since."""
    folders = checkpointed(load_folders(spark, root))
    marks = tables.loads_in_progress(spark, root, abandoned_hours)
    if not path_exists(spark, f"{root}/pipeline_runs"):
        return folders.where(~F.col("load_id").isin(marks)).withColumn("unused_since", F.col("last_change"))
    runs = checkpointed(tables.read_runs(spark, root).select(tables.LOAD_KEY).distinct())
    commits = checkpointed(_listing(spark, f"{root}/pipeline_runs", "*.parquet").groupBy(_part("run_id").alias("run_key")).agg(
        F.max("_changed").alias("_commit")))
    unused = folders.where(~F.col("load_id").isin(marks)).join(runs, "load_id", "left_anti").join(commits, "run_key", "left")
    return unused.select("table_name", "run_key", "load_id", "files", "bytes", "last_change",
                         F.greatest("last_change", "_commit").alias("unused_since"))


def remove_superseded(
    spark: SparkSession, root: str, min_age_hours: float = MIN_AGE_HOURS, abandoned_hours: float = ABANDONED_HOURS, dry_run: bool = False,
) -> DataFrame:
    """Remove what has been unused for `min_age_hours`; returns the rows of superseded_loads() that were (or would be) removed.

    The folders are removed by the driver: one call for each, whatever it holds.
    """
    age = (F.unix_micros(F.current_timestamp()) - F.unix_micros("unused_since")) / 3_600_000_000
    due = checkpointed(superseded_loads(spark, root, abandoned_hours).where(age >= min_age_hours))
    if not dry_run:
        for row in due.select("table_name", "run_key", "load_id").toLocalIterator():
            tables.remove_folder(spark, f"{root}/{row.table_name}", row.run_key, row.load_id)
    return due
