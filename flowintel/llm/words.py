"""Word counts as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowintel.llm.text import WORD


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
