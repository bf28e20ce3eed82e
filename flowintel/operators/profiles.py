"""Category aggregates and threat profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions import scoring
from flowintel.functions.advisories import advisories
from flowintel.functions.labels import normalize_category
from flowintel.operators.clean import require_columns

CURATED_SOURCE = "curated_dataset_flows"
MODEL_SOURCE = "model_inference"
_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def _exact_sum(col: str) -> Column:
    # decimal partial sums do not depend on the order in which rows arrive
    return F.sum(F.col(col).try_cast("decimal(30,4)"))


def _to_count(total: Column) -> Column:
    return F.coalesce(scoring.round_half_up(total), F.lit(0)).cast("bigint")


def flow_aggregates(
    df: DataFrame, window_type: str = "full_campaign", label_col: str = "label",
    ts_col: str = "timestamp_parsed", date_col: str = "event_date",
    campaign: tuple[str, str] = (dims.CAMPAIGN_START, dims.CAMPAIGN_END),
) -> DataFrame:
    """Counts, volumes, active units and first/last seen per label and window.

    full_campaign: one window, units are dates.  daily: one window per day, units are
    hours.  hourly: one window per hour, units are five-minute buckets.  Rows are first
    reduced per unit, so a label that owns most rows is spread over its units.
    """
    measures = ["tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts"]
    require_columns(df, [label_col, ts_col, date_col, *measures])
    ts = F.col(ts_col)
    if window_type == "full_campaign":
        start, end = (F.lit(x).cast("timestamp") for x in campaign)
        unit = F.col(date_col).cast("string")
    elif window_type == "daily":
        start = F.date_trunc("day", ts)
        end, unit = start + F.expr("interval 1 day"), F.hour(ts).cast("string")
    elif window_type == "hourly":
        start = F.date_trunc("hour", ts)
        end, unit = start + F.expr("interval 1 hour"), F.floor(F.minute(ts) / 5).cast("string")
    else:
        raise ValueError(f"unknown window type '{window_type}'")
    per_unit = (
        df.select(
            F.coalesce(F.col(label_col), F.lit("")).alias("label"),
            start.alias("window_start"),
            end.alias("window_end"),
            unit.alias("_unit"),
            ts.alias("_ts"),
            (F.col("totlen_fwd_pkts") + F.col("totlen_bwd_pkts")).alias("_bytes"),
            (F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")).alias("_packets"),
        )
        .groupBy("label", "window_start", "window_end", "_unit")
        .agg(
            F.count("*").alias("_flows"),
            _exact_sum("_bytes").alias("_bytes"),
            _exact_sum("_packets").alias("_packets"),
            F.min("_ts").alias("_first"),
            F.max("_ts").alias("_last"),
        )
    )
    return per_unit.groupBy("label", "window_start", "window_end").agg(
        F.sum("_flows").alias("flow_count"),
        _to_count(F.sum("_bytes")).alias("total_bytes"),
        _to_count(F.sum("_packets")).alias("total_packets"),
        F.count("_unit").cast("int").alias("active_observation_units"),
        F.min("_first").alias("first_seen_timestamp"),
        F.max("_last").alias("last_seen_timestamp"),
    ).withColumn("window_type", F.lit(window_type))


def add_severity(df: DataFrame, label_col: str = "canonical_label") -> DataFrame:
    lookup = dims.severity_priors(df.sparkSession).withColumnRenamed("label", label_col)
    return df.join(F.broadcast(lookup), label_col, "left").fillna(dims.DEFAULT_SEVERITY, ["severity_prior"])


def add_technique(df: DataFrame, label_col: str = "canonical_label") -> DataFrame:
    """Technique columns of the label, or the fallback row for labels outside the table."""
    lookup = dims.technique_mappings(df.sparkSession).withColumnRenamed("label", label_col)
    joined = df.join(F.broadcast(lookup), label_col, "left")
    fallback = F.array(*[F.lit(t) for t in dims.FALLBACK_TELEMETRY])
    return joined.withColumns({
        "mapping_status": F.coalesce("mapping_status", F.lit(dims.FALLBACK_STATUS)),
        "rationale": F.coalesce("rationale", F.lit(dims.FALLBACK_RATIONALE)),
        "missing_telemetry": F.coalesce("missing_telemetry", fallback),
    })


def add_risk_score(df: DataFrame, target_impact: Column | None = None) -> DataFrame:
    """`tlrs_result` struct for aggregates that carry canonical_label, counts and window_type."""
    return scoring.with_risk_score(add_severity(df), target_impact).drop("severity_prior")


def threat_profiles(
    aggregates: DataFrame, manifest_hash: str, run_id: str, source_type: str = CURATED_SOURCE,
    reliability: DataFrame | None = None, target_impact: Column | None = None,
) -> DataFrame:
    """One nested profile per aggregate row.

    `reliability` (class_name, status, rationale, validation metrics) is the fixed class
    list of a model and is only given when predictions are profiled.  Of metrics for several
    splits those for validation count; a class given twice would multiply its profiles and raises.
    """
    scored = add_technique(add_risk_score(normalize_category(aggregates), target_impact))
    if reliability is None:
        scored = scored.withColumn(
            "model_reliability", F.lit(None).cast("struct<class_name:string,status:string,rationale:string>"))
    else:
        if "split" in reliability.columns:
            reliability = reliability.where(F.col("split").isin("val", "validation"))
        repeated = F.count("*").over(Window.partitionBy("class_name")) > 1
        complaint = F.raise_error(F.concat(F.lit("more than one reliability row for "), "class_name"))
        columns = reliability.columns
        reliability = reliability.withColumn("_fault", F.when(repeated, complaint)).where("_fault is null").select(columns)
        # only the fixed classes can match, so at most that many rows are broadcast
        assessed = reliability.where(F.col("class_name").isin(dims.CLASS_LABELS)).select(
            F.col("class_name").alias("canonical_label"), F.struct(*reliability.columns).alias("model_reliability"))
        scored = scored.join(F.broadcast(assessed), "canonical_label", "left")
    denominator = scoring.recurrence_denominator(F.col("window_type"))
    start, end = (F.date_format(c, _TIME_FORMAT) for c in ("window_start", "window_end"))
    keyed = scored.withColumns({
        "window_start": start,
        "window_end": end,
        "profile_id": scoring.profile_id(F.lit(source_type), F.col("canonical_label"), start, end, F.col("window_type")),
        "recurrence_denominator": denominator,
        "run_id": F.lit(run_id),
        "source_manifest_hash": F.lit(manifest_hash),
        "schema_version": F.lit(scoring.SCHEMA_VERSION),
    })
    return keyed.select(
        "profile_id",
        scoring.snapshot_id(F.col("profile_id"), F.col("run_id"), F.col("source_manifest_hash")).alias("snapshot_id"),
        "run_id", "source_manifest_hash", "schema_version", "window_type", "window_start", "window_end",
        F.struct("canonical_label", "raw_label", "attack_status", "is_attack", "is_mapped").alias("category"),
        F.struct(
            "canonical_label", "technique_id", "technique_name", "tactic", "mapping_status", "rationale",
            "missing_telemetry",
        ).alias("mitre_mapping"),
        "flow_count", "total_bytes", "total_packets", "active_observation_units", "recurrence_denominator",
        "model_reliability",
        "tlrs_result",
        advisories(
            "canonical_label", "tlrs_result.scoring_status", "tlrs_result.risk_band",
            "tlrs_result.provisional_risk_band", "missing_telemetry", "model_reliability.status",
            "model_reliability.rationale",
        ).alias("advisories"),
    )


def status_counts(profiles: DataFrame) -> DataFrame:
    """Profiles by tri-state attack flag; null is unknown, not benign."""
    attack = F.col("category.is_attack")
    return profiles.agg(
        F.count("*").alias("total_profiles_generated"),
        F.count_if(attack).alias("attack_categories_count"),
        F.count_if(~attack).alias("benign_categories_count"),
        F.count_if(attack.isNull()).alias("unknown_categories_count"),
    )


def traffic_composition(profiles: DataFrame) -> DataFrame:
    """Flows and share per status; anything not BENIGN or ATTACK counts as UNKNOWN."""
    status = F.col("category.attack_status")
    grouped = profiles.groupBy(
        F.when(status.isin("BENIGN", "ATTACK"), status).otherwise(dims.UNKNOWN).alias("attack_status")
    ).agg(F.sum("flow_count").alias("flow_count"))
    total = F.sum("flow_count").over(Window.partitionBy())
    share = F.try_divide(F.col("flow_count").cast("double"), total.cast("double"))
    return grouped.select("attack_status", "flow_count", total.alias("total_flows"),
                          F.round(share * 100, 1).alias("percentage"))


def category_share(profiles: DataFrame) -> DataFrame:
    """Share of every profile in all flows; the total is a scalar subquery, so profiles are not brought into one task."""
    total = profiles.agg(F.sum("flow_count").alias("n")).scalar()
    share = F.coalesce(F.try_divide(F.col("flow_count").cast("double"), total.cast("double")), F.lit(0.0))
    return profiles.select(
        F.col("category.canonical_label").alias("canonical_label"),
        F.col("category.attack_status").alias("attack_status"),
        "flow_count",
        F.round(share * 100, 2).alias("percentage"),
    ).orderBy(F.desc("flow_count"), "canonical_label")


def mapping_status_counts(profiles: DataFrame) -> DataFrame:
    status = F.lower("mitre_mapping.mapping_status")
    return profiles.agg(
        F.count_if(status == "candidate").alias("candidate_count"),
        F.count_if(status == "unverified").alias("unverified_count"),
        F.count_if(status == "verified").alias("verified_count"),
        F.count_if(status == "not_applicable").alias("not_applicable_count"),
    )


def filter_by_mapping_status(profiles: DataFrame, wanted: str) -> DataFrame:
    return profiles.where(F.lower("mitre_mapping.mapping_status") == wanted.lower())


def recurrence_grid(profiles: DataFrame) -> DataFrame:
    """One cell per profile and day slot, active while the slot is below the active units.

    Row order: attacks first, then most active units.
    """
    flat = profiles.select(
        F.col("category.canonical_label").alias("canonical_label"),
        F.col("category.attack_status").alias("attack_status"),
        "active_observation_units",
        F.explode(F.sequence(F.lit(0), F.col("recurrence_denominator") - 1)).alias("slot"),
    )
    return flat.select(
        "canonical_label", "attack_status", "slot",
        F.format_string("D%d", F.col("slot") + 1).alias("slot_label"),
        (F.col("slot") < F.col("active_observation_units")).cast("int").alias("active"),
        F.when(F.col("attack_status") == "ATTACK", 0).otherwise(1).alias("status_order"),
        "active_observation_units",
    ).orderBy("status_order", F.desc("active_observation_units"), "canonical_label", "slot")
