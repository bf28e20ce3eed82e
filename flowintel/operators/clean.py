"""Audit and cleaning of raw flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.labels import standard_label
from flowintel.functions.numeric import TOKEN_CHECKS, finite_or_zero
from flowintel.functions.timeparse import FLOW_PATTERN, parse_flow_timestamp
from flowintel.session import limit_methods

RAW_LABEL = "Label"


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def is_repeated_header(label: Column) -> Column:
    return label == RAW_LABEL


def without_repeated_headers(df: DataFrame, label_col: str = RAW_LABEL) -> DataFrame:
    """Drop header lines repeated inside the data; a null label is dropped with them."""
    return df.where(F.col(label_col) != RAW_LABEL)


def audit_repeated_headers(df: DataFrame, label_col: str = RAW_LABEL, file_col: str = "source_file") -> DataFrame:
    """Repeated header rows per source file."""
    return (
        df.where(is_repeated_header(F.col(label_col)))
        .groupBy(F.col(file_col).alias("file"))
        .agg(F.count("*").alias("repeated_headers_count"))
    )


def token_counters(columns: list[str], where: str = "true") -> Column:
    """Aggregate: an array of structs with the token counts of each text column, over the rows that meet `where`."""
    return F.array(*[
        F.expr(f"named_struct('column_name', '{name}', " + ", ".join(
            f"'{key}', count_if({where} AND ({check.format(c=f'`{name}`')}))" for key, check in TOKEN_CHECKS.items())
            + f", 'rows_profiled', count_if({where}))")
        for name in columns
    ])


def profile_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null/blank, +inf, -inf and NaN counts of text columns, one row per column.

    All counters of all columns come from one pass over the data.
    """
    present = [c for c in (columns or dims.PROFILED_COLUMNS) if c in df.columns]
    return df.agg(token_counters(present).alias("profiles")).select(F.inline("profiles"))


def rename_columns(df: DataFrame) -> DataFrame:
    """CSV names to snake case, in one projection; other columns are kept."""
    return df.selectExpr(*[f"`{c}` AS `{dims.COLUMN_MAPPING.get(c, c)}`" for c in df.columns])


def _typed_value(name: str, raw: str) -> str:
    """SQL text that types one raw column and names it once; the columns that _sanitized_value() finishes stay text."""
    if name in dims.INT_COLUMNS:
        return f"try_cast(`{raw}` AS int)"
    if name in dims.RAW_BY_SNAKE and name not in (*dims.RATE_COLUMNS, dims.RATIO_COLUMN, "timestamp", "label"):
        return f"try_cast(`{raw}` AS double)"
    return f"`{raw}`"


def _sanitized_value(name: str, names: set[str]) -> str:
    """SQL text that finishes one renamed column."""
    if name in dims.RATE_COLUMNS:
        return finite_or_zero(f"`{name}`")
    if name == dims.RATIO_COLUMN:
        value = finite_or_zero(f"`{name}`")
        return f"CASE WHEN tot_fwd_pkts = 0 THEN 0.0D ELSE {value} END" if "tot_fwd_pkts" in names else value
    return f"`{name}`"


def typed_flows(raw: DataFrame) -> DataFrame:
    """Header rows removed, columns renamed, cast and sanitized, labels standardized; no row filter yet.

    The first projection names each raw column once, so Spark joins it with whatever makes the text, and wide rows of
    text are never built; the few columns that are looked at repeatedly follow in the second.
    """
    limit_methods(raw.sparkSession)
    names = {c: dims.COLUMN_MAPPING.get(c, c) for c in raw.columns}
    typed = without_repeated_headers(raw).selectExpr(*[f"{_typed_value(snake, c)} AS `{snake}`" for c, snake in names.items()])
    parsed, present = f"try_to_timestamp(timestamp, '{FLOW_PATTERN}')", set(names.values())
    return typed.select(
        *[standard_label(F.col(n)).alias(n) if n == "label" else F.expr(f"{_sanitized_value(n, present)} AS `{n}`") for n in names.values()],
        F.col("label").alias("raw_label"), F.expr(f"{parsed} AS timestamp_parsed"), F.expr(f"to_date({parsed}) AS event_date"))


def valid_duration() -> Column:
    """Duration present and not negative."""
    return F.col("flow_duration") >= 0


def clean_flows(raw: DataFrame) -> DataFrame:
    """Curated flows: typed rows with a valid duration and a parsable timestamp."""
    return typed_flows(raw).where(valid_duration() & F.col("event_date").isNotNull())


def cleaning_counters() -> list[Column]:
    """Row accounting over raw records, to be used in any aggregation."""
    label, duration = F.col(RAW_LABEL), F.col("Flow Duration").try_cast("double")
    is_flow = F.coalesce(label != RAW_LABEL, F.lit(False))
    kept_duration = is_flow & F.coalesce(duration >= 0, F.lit(False))
    bad_time = parse_flow_timestamp(F.col("Timestamp")).isNull()
    return [
        F.count("*").alias("input_rows"),
        F.count_if(is_repeated_header(label)).alias("repeated_header_rows"),
        F.count_if(label.isNull()).alias("null_label_rows"),
        F.count_if(is_flow).alias("pre_cleaning_rows"),
        F.count_if(kept_duration & ~bad_time).alias("retained_rows"),
        F.count_if(is_flow & ~kept_duration).alias("negative_duration_dropped"),
        F.count_if(is_flow & duration.isNull()).alias("null_duration_rows"),
        F.count_if(is_flow & (F.col("Tot Fwd Pkts").try_cast("double") < 1)).alias("diagnostic_zero_fwd_pkts_count"),
        F.count_if(kept_duration & bad_time).alias("invalid_timestamp_dropped"),
        F.count_if((is_flow & ~kept_duration) | (kept_duration & bad_time)).alias("semantically_invalid_dropped"),
    ]


def cleaning_metrics(raw: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Row accounting of the cleaning rules, over everything or per `by` columns, in one pass."""
    return raw.groupBy(*(by or [])).agg(*cleaning_counters())


def cleaning_audit(raw: DataFrame, file_col: str = "source_file", columns: list[str] | None = None) -> DataFrame:
    """Everything the cleaning report counts, one row per file, from one pass over the raw text.

    The row accounting of cleaning_metrics() and, as `profiles`, the token counts of the flow rows (no repeated header,
    no null label) per column.  Header audit, token profile and totals are sums over these few rows.
    """
    limit_methods(raw.sparkSession)
    present = [c for c in (columns or dims.PROFILED_COLUMNS) if c in raw.columns]
    is_flow = f"coalesce(`{RAW_LABEL}` <> '{RAW_LABEL}', false)"
    return raw.groupBy(file_col).agg(*cleaning_counters(), token_counters(present, is_flow).alias("profiles"))


def audited_totals(audit: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Row accounting over all files of a cleaning_audit()."""
    return audit.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in audit.columns if c not in (file_col, "profiles")])


def audited_headers(audit: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Repeated header rows per file that has some."""
    return audit.where(F.col("repeated_header_rows") > 0).select(
        F.col(file_col).alias("file"), F.col("repeated_header_rows").alias("repeated_headers_count"))


def audited_tokens(audit: DataFrame) -> DataFrame:
    """Token profile over all files, one row per column."""
    counts = [*TOKEN_CHECKS, "rows_profiled"]
    return audit.select(F.inline("profiles")).groupBy("column_name").agg(*[F.sum(c).alias(c) for c in counts])


def clean_and_transform(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curated flows and their row accounting; both lazy, neither collects."""
    return clean_flows(raw), cleaning_metrics(raw)


def verify_integrity(
    df: DataFrame, expected_rows: int | None = None, expected_dates: int | None = None,
    date_col: str = "event_date", audited: list[str] | None = None, cells: DataFrame | None = None,
) -> DataFrame:
    """One row: rows, columns, sorted dates, null/NaN counts and the pass flag.

    Counted per date first, so that the final row only merges one row per date; from `cells`
    (distribution.flow_cells) when they are given, so that the rows are not read again.
    """
    audited = audited or dims.INTEGRITY_COLUMNS
    date = F.col(date_col).cast("string").alias("_date")
    if cells is not None:
        per_date = cells.groupBy(date).agg(
            F.sum("flow_count").alias("_rows"), *[F.sum(f"{c}_null_or_nan").alias(f"{c}_null_or_nan") for c in audited])
    else:
        per_date = df.groupBy(date).agg(
            F.count("*").alias("_rows"),
            *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"{c}_null_or_nan") for c in audited])
    summary = per_date.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("verified_rows"),
        F.array_sort(F.collect_list("_date")).alias("partition_dates"),
        *[F.coalesce(F.sum(f"{c}_null_or_nan"), F.lit(0)).alias(f"{c}_null_or_nan") for c in audited],
    )
    passed = F.lit(True)
    for c in audited:
        passed = passed & (F.col(f"{c}_null_or_nan") == 0)
    if expected_rows is not None:
        passed = passed & (F.col("verified_rows") == expected_rows)
    if expected_dates is not None:
        passed = passed & (F.size("partition_dates") == expected_dates)
    return summary.select(
        "verified_rows",
        F.lit(len(df.columns)).alias("verified_columns"),
        F.size("partition_dates").alias("partitions_count"),
        "partition_dates",
        *[f"{c}_null_or_nan" for c in audited],
        passed.alias("passed_integrity_checks"),
    )


def feature_quality(df: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """Null and non-finite counts per feature (and per `by` value), in one pass."""
    counters = [
        F.expr(
            f"named_struct('feature', '{f}', 'null_count', count_if({f} IS NULL), 'non_finite_count', "
            f"count_if(isnan(cast({f} AS double)) OR abs(cast({f} AS double)) = double('Infinity')))")
        for f in features
    ]
    keys = [by] if by else []
    return df.groupBy(*keys).agg(F.array(*counters).alias("q")).select(*keys, F.inline("q"))
