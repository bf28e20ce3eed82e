"""Search, paging and detail lookups over profiles and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.reliability import resolve_tier

MAX_PAGE = 100


def profile_filter(
    run_id: str | None = None, canonical_label: str | None = None, search: str | None = None,
    attack_status: str | None = None, is_attack: bool | None = None,
) -> Column:
    """AND of the given filters; the search text is trimmed, case-insensitive, on either label."""
    keep = F.lit(True)
    if run_id:
        keep = keep & (F.col("run_id") == run_id)
    if canonical_label:
        keep = keep & (F.col("canonical_label") == canonical_label)
    if search and search.strip():
        text = search.strip().lower()
        keep = keep & (F.lower("canonical_label").contains(text) | F.lower("raw_label").contains(text))
    if attack_status and attack_status != "ALL":
        keep = keep & (F.col("attack_status") == attack_status)
    if is_attack is not None:
        keep = keep & (F.col("is_attack") == is_attack)
    return keep


def search_profiles(profiles: DataFrame, **filters) -> DataFrame:
    return profiles.where(profile_filter(**filters))


def matched_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows offset .. offset+limit of the given total order."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1..{MAX_PAGE}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_profiles(profiles: DataFrame, limit: int = 20, offset: int = 0, **filters) -> DataFrame:
    """Page of profiles by flow count; the key breaks ties so that pages never overlap."""
    order = [F.desc("flow_count"), F.col("snapshot_id")]
    return page(search_profiles(profiles, **filters), order, limit, offset)


def valid_page_index(total: int, page_size: int, index: int) -> int:
    """A page index past the end falls back to the first page."""
    last = max(0, -(-total // page_size) - 1)
    return index if index <= last else 0


def recent_runs(runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return page(runs, [F.desc("run_timestamp"), F.col("run_id")], limit, offset)


def latest_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs, 1)


def rows_for_run(table: DataFrame, run_id: str) -> DataFrame:
    return table.where(F.col("run_id") == run_id)


def profile_details(
    profiles: DataFrame, risk: DataFrame, mappings: DataFrame, advisories: DataFrame,
) -> DataFrame:
    """Profile with its risk, mapping and ordered advisories, all keyed by snapshot_id."""
    listed = advisories.groupBy("snapshot_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "recommendation_id", "priority", "action_type", "summary"))),
            lambda a: a.dropFields("position"),
        ).alias("advisories"))
    keep_risk = [c for c in risk.columns if c not in ("run_id", "load_id")]
    keep_map = ["snapshot_id", "technique_id", "technique_name", "tactic", "mapping_status", "is_confirmed"]
    return (
        profiles.join(risk.select(keep_risk).withColumnRenamed("is_confirmed", "risk_confirmed"), "snapshot_id")
        .join(mappings.select(keep_map).withColumnRenamed("is_confirmed", "mapping_confirmed"), "snapshot_id")
        .join(listed, "snapshot_id", "left")
    )


def missing_snapshots(wanted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requested snapshot ids without a profile."""
    return wanted.select("snapshot_id").join(profiles, "snapshot_id", "left_anti")


def with_reliability_tier(profiles: DataFrame, diagnostics: DataFrame | None) -> DataFrame:
    """Tier per profile; `diagnostics` is the fixed class list (class_name, official_reliability_tier)."""
    if diagnostics is None:
        joined = profiles.withColumn("_tier", F.lit(None).cast("string"))
    else:
        # only the fixed classes can match, so at most that many rows are broadcast
        tiers = diagnostics.where(F.col("class_name").isin(dims.CLASS_LABELS)).select(
            F.col("class_name").alias("canonical_label"), F.col("official_reliability_tier").alias("_tier"))
        joined = profiles.join(F.broadcast(tiers), "canonical_label", "left")
    tier = resolve_tier(
        F.col("model_reliability"), F.col("is_attack"), F.col("canonical_label"),
        F.lit(diagnostics is not None), F.col("_tier"))
    return joined.withColumn("resolved_reliability_tier", tier).drop("_tier")
