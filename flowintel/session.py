"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its row count was proven to stay below this bound.
BROADCAST_ROW_LIMIT = 100_000
# The JVM does not compile methods with more bytes, which then run interpreted.
COMPILED_METHOD_BYTES = "8000"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# Rows of a reduced result that one task reads at least.
ROWS_PER_TASK = 20_000
# Rows of a scan that one task may hold while other cores are idle.
UNSPREAD_ROWS = 250_000
# Rows of a task of a dealt scan, at most; what a task sorts stays in memory.
DEALT_ROWS = 1_000_000
# How much longer than evenly dealt rows the tasks of a scan may take.
UNEVEN = 1.25


def build_session(app: str = "flowintel", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library relies on: UTC, AQE, skew-join handling, compiled methods."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(_METHOD_LIMIT, COMPILED_METHOD_BYTES)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def limit_methods(spark: SparkSession) -> None:
    """Also in sessions of other make, let wide projections fall into methods that the JVM compiles.

    The plan runs after the caller has it, so the setting stays in the session; a limit that the session has set stays as it is.
    """
    if spark.conf.get(_METHOD_LIMIT, None) is None:
        spark.conf.set(_METHOD_LIMIT, COMPILED_METHOD_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the cluster's setting when there is one.

    In local mode without the setting it lies below the warehouse folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize a reduced result once, so a lost executor does not recompute its inputs."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialize many wide rows once, as Parquet in the checkpoint folder: a fraction of the disk that `checkpointed` takes."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int) -> int:
    """Number of tasks that reduced rows are worth; a coalesce to more partitions than there are changes nothing."""
    return rows // ROWS_PER_TASK + 1


def compacted(df: DataFrame) -> DataFrame:
    """`checkpointed`, and read in no more tasks than its rows are worth.

    Each task that writes a shuffle leaves three files of a block or more, so a small result in hundreds of
    partitions, exchanged again and again, fills disks with nearly empty files.
    """
    stored = checkpointed(df)
    return stored.coalesce(tasks_for(stored.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan, dealt out anew where its tasks would leave cores idle and one of them holds many rows.

    A Parquet row group is read by one task, however large it is, and that task then does all that follows; so few
    tasks, or tasks that come out uneven, hold up the rest.  The rows per task are counted from the files' footers.
    Rows are dealt by their place in the scan, which is the same on a retry, so they are neither sorted nor is a
    common row dealt to one task.  Suits narrow rows whose further work is wide.
    """
    found = df.groupBy(F.spark_partition_id().alias("_task")).agg(F.count("*").alias("_n")).agg(
        F.count("*").alias("tasks"), F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    cores, most = df.sparkSession.sparkContext.defaultParallelism, found["most"] or 0
    rounds = -(-found["tasks"] // cores)
    if most <= UNSPREAD_ROWS or found["tasks"] >= cores and rounds * most * cores <= UNEVEN * found["rows"]:
        return df
    tasks = max(3 * cores, -(-found["rows"] // DEALT_ROWS))
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(tasks, "_place").drop("_place")


def join_per_key(
    df: DataFrame, table: DataFrame, on: str | list[str] | Column, how: str = "left",
    max_rows: int = BROADCAST_ROW_LIMIT,
) -> DataFrame:
    """Join rows with a per-key table that was derived from the data.

    The table is materialized and counted first, so jobs run while the plan is built; the
    bound counts rows, not bytes, and suits tables of narrow rows.  Up to `max_rows` it is broadcast, so
    the wide side is neither shuffled nor sorted, whatever its skew.  A larger table is
    joined with a shuffle, where AQE splits skewed partitions.
    """
    table = checkpointed(table)
    small = table.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(table) if small else table, on, how)
