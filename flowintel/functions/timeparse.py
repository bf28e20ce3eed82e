"""Timestamp parsing and half-open windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted patterns, tried in this order
FLOW_PATTERN = "dd/MM/yyyy HH:mm:ss"
ISO_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd"]


def parse_flow_timestamp(text: Column) -> Column:
    """Strict flow-record pattern; anything else is null."""
    return F.try_to_timestamp(text, F.lit(FLOW_PATTERN))


def parse_timestamp(text: Column, required: bool = False) -> Column:
    """ISO forms first, then the flow pattern.  `required` raises on unparsable text."""
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in [*ISO_PATTERNS, FLOW_PATTERN]])
    if not required:
        return parsed
    failure = F.raise_error(F.concat(F.lit("Unable to parse timestamp: "), F.coalesce(text, F.lit("null"))))
    return F.when(parsed.isNull(), failure.cast("timestamp")).otherwise(parsed)


def in_window(ts: Column, start: Column, end: Column) -> Column:
    """start <= ts < end."""
    return (ts >= start) & (ts < end)


def normalized_path(path: Column) -> Column:
    """Comparable form of a path: forward slashes, lower case, no trailing slash."""
    unified = F.lower(F.regexp_replace(path, r"\\", "/"))
    return F.regexp_replace(F.regexp_replace(unified, "(^|/)(\\./)+", "$1"), "(.)/+$", "$1")
