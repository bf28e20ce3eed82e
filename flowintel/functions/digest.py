"""Order-independent content digests in constant memory, the same at any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 8


def row_text(columns: list[str]) -> Column:
    """Unambiguous text of a row: every field with its length, null as a mark of its own."""
    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.when(F.col(name).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text))

    return F.concat(*[field(c) for c in columns])


def content_digest(row_hash: Column) -> Column:
    """Aggregate: SHA-256 over the row count and the sums of the 32-bit limbs of all row hashes (64 hex digits)."""
    sums = [
        F.coalesce(F.sum(F.conv(F.substring(row_hash, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
        for i in range(LIMBS)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256)
