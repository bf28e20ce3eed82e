"""Content manifests: per-file hashes and one digest for a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel.functions.digest import content_digest, row_text
from flowintel.sources.digests import file_digests
from flowintel.sources.files import qualified

DIGEST_LENGTH = 16
# Largest file that is read into one value; Spark's bound is 2 GB, and a task holds the value more than once.
WHOLE_BYTES = 64 << 20


def file_entries(spark: SparkSession, paths: str | list[str], base: str | None = None, **options: int) -> DataFrame:
    """path (relative to `base` or the folder), sha256, size_bytes of every data file at or below `paths`.

    Files are streamed in chunks, whatever their size; folders are searched recursively, without names that begin
    with a dot or an underscore.  A path listed twice gives two entries.
    """
    return file_digests(spark, paths, base, **options)


def whole_entries(spark: SparkSession, folder: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The entries of a folder's files by other means than file_entries(): files up to `whole_bytes` are read into one value
    and hashed by Spark, larger ones, which no value can hold, and empty ones, which Spark leaves out, by the digest of
    Python's library over the opened file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring("path", F.lit(len(qualified(spark, folder).rstrip("/")) + 2), F.length("path"))
    small = files.where(F.col("length").between(1, whole_bytes)).select(
        name.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))
    return small.unionByName(file_digests(spark, folder, larger_than=whole_bytes))


def entries_from_content(df: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """Same entry shape for a table that stores one document per row."""
    return df.select(
        F.col(path_col).cast("string").alias("path"),
        F.sha2(F.col(content_col).cast("binary"), 256).alias("sha256"),
        F.octet_length(content_col).cast("bigint").alias("size_bytes"),
    )


def manifest(entries: DataFrame) -> DataFrame:
    """One row: source_manifest_hash, files_count, total_bytes.

    The hash sums the hashes of the entries, so it depends neither on their order nor on
    their number, and no task holds a list of files.
    """
    row_hash = F.sha2(row_text(["path", "sha256", "size_bytes"]), 256)
    return entries.agg(
        F.substring(content_digest(row_hash), 1, DIGEST_LENGTH).alias("source_manifest_hash"),
        F.count("*").alias("files_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def duplicate_files(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming entries whose content is already known; names do not matter."""
    return incoming.join(known.select("sha256").distinct(), "sha256", "left_semi")


def novel_files(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming entries to ingest: content neither known nor repeated under a smaller path."""
    first = incoming.groupBy("sha256").agg(F.min_by(F.struct("path", "size_bytes"), "path").alias("_file"))
    return (
        first.join(known.select("sha256").distinct(), "sha256", "left_anti")
        .select("_file.path", "sha256", "_file.size_bytes")
    )
