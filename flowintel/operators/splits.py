"""Train / validation / test splits, sampling and class weights.

Every split is returned as the input plus a `split` column; the three parts are plain
filters on it and therefore disjoint.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel import dims
from flowintel.functions.numeric import ratio, uniform_from_keys
from flowintel.operators import ranks
from flowintel.session import checkpointed, join_per_key

SPLITS = ["train", "val", "test"]
STRATEGIES = ["global_chronological", "chronological_per_class", "inter_day_chronological", "stratified_random"]
SAMPLE_BUCKETS = 1_000_000


@dataclass(frozen=True)
class TrainingConfig:
    split_strategy: str = "global_chronological"
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    include_dst_port: bool = False
    prune_collinear_subflows: bool = True
    use_class_weights: bool = True
    max_class_weight: float = 500.0
    num_trees: int = 50
    max_depth: int = 10
    max_bins: int = 32
    seed: int = 42
    subsample_ratio: float | None = None
    subsample_strategy: str = "stratified_per_class"
    protect_rare_classes: bool = True
    min_rare_class_samples: int = 500
    apply_threshold_policy: bool = False
    taus: dict[int, float] = field(default_factory=lambda: dict(dims.TAU_BY_CLASS))
    # columns that identify a row for hashed splits and samples
    row_keys: tuple[str, ...] = ()
    # most rows of a class that a model is fitted on; None for all
    fit_rows_per_class: int | None = None

    def __post_init__(self):
        ranges = {
            "train_ratio": (0.1, 0.9), "val_ratio": (0.05, 0.5), "test_ratio": (0.05, 0.5),
            "num_trees": (1, 500), "max_depth": (1, 30), "max_bins": (8, 128),
        }
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be in [{low}, {high}]")
        if any(not 0.0 <= t <= 1.0 for t in self.taus.values()):
            raise ValueError("thresholds must be in [0, 1]")


def distinct_timestamps(df: DataFrame, ts_col: str = "timestamp_parsed", by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(ts_col).isNotNull()).select(*(by or []), ts_col).distinct()


def timestamp_cells(df: DataFrame, ts_col: str = "timestamp_parsed", label_col: str = "label") -> DataFrame:
    """Rows per (label, timestamp) as flow_count, stored, without rows that have no timestamp.

    A split by time gives all rows of a cell the same part.  Where only numbers of rows, labels and timestamps are wanted of
    it, cutoffs and parts are found from the cells (pass weight="flow_count"), so that the rows are made and read once.
    """
    return checkpointed(df.where(F.col(ts_col).isNotNull()).groupBy(label_col, ts_col).agg(F.count("*").alias("flow_count")))


def timestamp_ranks(
    df: DataFrame, ts_col: str = "timestamp_parsed", by: list[str] | None = None, limit: int = ranks.STAMPS_PER_RANGE,
) -> DataFrame:
    """Chronological dense rank of the distinct timestamps (per `by`) with their number; at most `limit` are sorted together."""
    return ranks.ranked(df, ts_col, by or [], limit)


def _cut_ranks(n: Column, train_ratio: float, val_ratio: float) -> tuple[Column, Column]:
    """Last rank of train and of val; from three timestamps on, every part gets at least one."""
    first = F.greatest(F.lit(1), F.least(F.floor(n * train_ratio), n - 2))
    second = F.greatest(first + 1, F.least(F.floor(n * (train_ratio + val_ratio)), n - 1))
    return F.when(n <= 2, 1).otherwise(first), F.when(n <= 2, 1).otherwise(second)


def split_cutoffs(
    df: DataFrame, ts_col: str = "timestamp_parsed", by: list[str] | None = None,
    train_ratio: float = 0.70, val_ratio: float = 0.15, limit: int = ranks.STAMPS_PER_RANGE,
) -> DataFrame:
    """Last train and last val timestamp, over everything or per `by` group.

    Only the ranges of time that hold one of the two cut ranks are narrowed, and only the
    timestamps of the last such ranges are sorted.
    """
    by = by or []
    k1, k2 = _cut_ranks(F.col("distinct_count"), train_ratio, val_ratio)

    def holds() -> Column:
        return F.exists(F.array(k1, k2), lambda k: (F.col("_before") < k) & (k <= F.col("_before") + F.col("_n")))

    picked = ranks.ranked(df, ts_col, by, limit, holds)
    return picked.groupBy(*by).agg(
        F.max(F.when(F.col("d_rank") == k1, F.col(ts_col))).alias("train_until"),
        F.max(F.when(F.col("d_rank") == k2, F.col(ts_col))).alias("val_until"))


def _split_by_time(ts: Column, train_until: Column, val_until: Column) -> Column:
    return F.when(ts <= train_until, "train").when(ts <= val_until, "val").otherwise("test")


def split_global(
    df: DataFrame, train_ratio: float = 0.70, val_ratio: float = 0.15, ts_col: str = "timestamp_parsed",
) -> DataFrame:
    """One pair of cutoffs for all classes: equal timestamps never end up in different parts.

    The cutoffs enter as a scalar subquery, so the rows themselves are neither joined nor
    shuffled.  Rows without a timestamp belong to no part and are left out.
    """
    cut = split_cutoffs(df, ts_col, None, train_ratio, val_ratio).select(F.struct("train_until", "val_until")).scalar()
    ts = F.col(ts_col)
    return df.where(ts.isNotNull()).withColumn(
        "split", _split_by_time(ts, cut["train_until"], cut["val_until"]))


def split_per_class(
    df: DataFrame, train_ratio: float = 0.70, val_ratio: float = 0.15, ts_col: str = "timestamp_parsed",
    label_col: str = "label",
) -> DataFrame:
    """Cutoffs per class, looked up by label; the rows of a dominant class are never sorted."""
    cuts = split_cutoffs(df, ts_col, [label_col], train_ratio, val_ratio).withColumnRenamed(label_col, "_label")
    tagged = join_per_key(
        df.where(F.col(ts_col).isNotNull()), cuts, F.col(label_col).eqNullSafe(F.col("_label")), "inner")
    split = _split_by_time(F.col(ts_col), F.col("train_until"), F.col("val_until"))
    return tagged.select(*df.columns, split.alias("split"))


def split_inter_day(
    df: DataFrame, date_col: str = "event_date", train_dates: list[str] | None = None,
    val_dates: list[str] | None = None,
) -> DataFrame:
    date = F.col(date_col).cast("string")
    split = (
        F.when(date.isin(train_dates or dims.INTER_DAY_TRAIN), "train")
        .when(date.isin(val_dates or dims.INTER_DAY_VAL), "val")
        .otherwise("test")
    )
    return df.withColumn("split", split)


def split_hashed(
    df: DataFrame, keys: list[str], train_ratio: float = 0.70, val_ratio: float = 0.15, seed: int = 42,
) -> DataFrame:
    """Pseudo-random split by a hash of the key columns; rows with equal keys stay together."""
    bucket = uniform_from_keys(keys, seed, 100)
    split = (
        F.when(bucket < int(train_ratio * 100), "train")
        .when(bucket < int((train_ratio + val_ratio) * 100), "val")
        .otherwise("test")
    )
    return df.withColumn("split", split)


def split_dataset(df: DataFrame, config: TrainingConfig) -> DataFrame:
    if config.split_strategy == "global_chronological":
        return split_global(df, config.train_ratio, config.val_ratio)
    if config.split_strategy == "chronological_per_class":
        return split_per_class(df, config.train_ratio, config.val_ratio)
    if config.split_strategy == "inter_day_chronological":
        return split_inter_day(df)
    if config.split_strategy == "stratified_random":
        keys = list(config.row_keys) or ["label", "timestamp_parsed", "flow_duration"]
        return split_hashed(df, keys, config.train_ratio, config.val_ratio, config.seed)
    raise ValueError(f"unknown split strategy '{config.split_strategy}'")


def parts(tagged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(tagged.where(F.col("split") == s) for s in SPLITS)


def split_coverage(tagged: DataFrame, label_col: str = "label", weight: str | None = None) -> DataFrame:
    """Support per class and part, and how much of the time span the class covers.

    All known classes are listed, also those without rows.
    """
    rows = F.lit(1) if weight is None else F.col(weight)
    counts = tagged.groupBy(F.col(label_col).alias("class_name")).agg(
        *[F.sum(F.when(F.col("split") == s, rows).otherwise(0)).alias(f"{s}_support") for s in SPLITS])
    every = dims.classes(tagged.sparkSession).select("class_name")
    full = every.join(counts, "class_name", "left").fillna(0)
    in_train, in_val, in_test = (F.col(f"{s}_support") > 0 for s in SPLITS)
    coverage = (
        F.when(in_train & in_val & in_test, "full_span")
        .when(in_train & ~in_val & ~in_test, "train_only")
        .when(~in_train & ~in_val & in_test, "test_only")
        .when(~in_train & in_val & ~in_test, "val_only")
        .when(in_train | in_val | in_test, "partial_span")
        .otherwise("zero_dataset_support")
    )
    return full.select(
        "*", (~in_train).alias("zero_train_support"), (~in_test).alias("zero_test_support"),
        coverage.alias("temporal_coverage"))


def split_totals(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("split").agg(F.count("*").alias("total_rows"))


def verify_split(tagged: DataFrame, expected: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per part against expected rows (split, expected_rows), with the class counts."""
    per_class = tagged.groupBy("split", label_col).agg(F.count("*").alias("n"))
    found = per_class.groupBy("split").agg(
        F.sum("n").alias("total_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label_col, "n")))).alias("class_counts"))
    joined = found.join(expected, "split", "full_outer")
    return joined.select(
        "split", F.coalesce("total_rows", F.lit(0)).alias("total_rows"), "expected_rows",
        F.coalesce(F.coalesce("total_rows", F.lit(0)) == F.col("expected_rows"), F.lit(False)).alias("split_match"),
        "class_counts")


def tag_sample(
    df: DataFrame, sample_ratio: float | None, strategy: str = "stratified_per_class", protect_rare: bool = True,
    min_rare: int = 500, seed: int = 42, keys: list[str] | None = None, label_col: str = "label",
) -> DataFrame:
    """Input plus `_sampled`; a ratio outside (0, 1) keeps every row.

    The draw is a hash of `keys`, or of all columns without them, so a lost task draws the
    same rows again.  Rows equal in these columns are kept or dropped together.
    """
    if sample_ratio is None or not 0.0 < sample_ratio < 1.0:
        return df.withColumn("_sampled", F.lit(True))
    draw = uniform_from_keys(keys or df.columns, seed, SAMPLE_BUCKETS) / SAMPLE_BUCKETS
    if strategy == "uniform_random" or (strategy == "stratified_per_class" and not protect_rare):
        return df.withColumn("_sampled", draw < sample_ratio)
    if strategy != "stratified_per_class":
        raise ValueError(f"unknown subsample strategy '{strategy}'")
    rare = (
        df.groupBy(F.col(label_col).alias("_rare_label")).agg(F.count("*").alias("_n"))
        .where(F.col("_n") <= min_rare).select("_rare_label")
    )
    tagged = join_per_key(df, rare, F.col(label_col) == F.col("_rare_label"))
    return tagged.select(*df.columns, (F.col("_rare_label").isNotNull() | (draw < sample_ratio)).alias("_sampled"))


def subsample(df: DataFrame, sample_ratio: float | None, **options) -> DataFrame:
    return tag_sample(df, sample_ratio, **options).where("_sampled").drop("_sampled")


def sampling_by_class(
    tagged: DataFrame, protect_rare: bool = True, min_rare: int = 500, label_col: str = "label",
) -> DataFrame:
    """Rows before and after sampling per class, and whether the class was protected."""
    return tagged.groupBy(label_col).agg(
        F.count("*").alias("pre_sample_count"), F.count_if("_sampled").alias("post_sample_count")
    ).withColumn("is_protected", F.lit(protect_rare) & (F.col("pre_sample_count") <= min_rare))


def sampling_summary(by_class: DataFrame, sample_ratio: float) -> DataFrame:
    pre, post = F.sum("pre_sample_count"), F.sum("post_sample_count")
    expected = F.floor(pre * sample_ratio)
    return by_class.agg(
        pre.alias("total_pre_sampling"), post.alias("total_post_sampling"),
        F.round(ratio(post, F.greatest(pre, F.lit(1))), 6).alias("effective_subsample_ratio"),
        expected.alias("expected_rows_unprotected"),
        F.greatest(F.lit(0), post - expected).alias("excess_rows_from_protection"),
        F.count_if("is_protected").alias("protected_classes"),
    )


def class_weights(train: DataFrame, max_weight: float = 500.0, label_col: str = "label") -> DataFrame:
    """Inverse-frequency weight per class, capped: N / (K * N_c) over the classes present."""
    everything = Window.partitionBy()
    counts = train.groupBy(label_col).agg(F.count("*").alias("class_count"))
    raw = ratio(
        F.sum("class_count").over(everything), F.count("*").over(everything) * F.col("class_count"))
    return counts.select(label_col, "class_count", F.round(F.least(raw, F.lit(float(max_weight))), 4).alias("weight"))


def add_class_weights(train: DataFrame, weights: DataFrame, label_col: str = "label") -> DataFrame:
    table = weights.select(label_col, "weight")
    return join_per_key(train, table, label_col).fillna(1.0, ["weight"])


def add_neutral_weight(df: DataFrame) -> DataFrame:
    """Validation and test rows count once."""
    return df.withColumn("weight", F.lit(1.0))


def label_audit(tagged: DataFrame, index_col: str = "label_idx") -> DataFrame:
    """Rows with an unknown (-1) or null class index per part."""
    return tagged.groupBy("split").agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col(index_col) == -1.0).alias("invalid_label_rows"),
        F.count_if(F.col(index_col).isNull()).alias("null_label_rows"),
    )


def split_date_counts(tagged: DataFrame, focus_label: str = "Infiltration", label_col: str = "label",
                      date_col: str = "event_date") -> DataFrame:
    """Rows per part and date: all, benign, and one class of interest."""
    return tagged.groupBy("split", F.col(date_col).cast("date").alias("event_date")).agg(
        F.count("*").alias("all_rows"),
        F.count_if(F.col(label_col) == dims.BENIGN).alias("benign_rows"),
        F.count_if(F.col(label_col) == focus_label).alias("focus_rows"),
    )


def overlap(tagged: DataFrame, ts_col: str = "timestamp_parsed") -> DataFrame:
    """Timestamps that occur in more than one part; empty for a chronological split."""
    return tagged.groupBy(ts_col).agg(F.count_distinct("split").alias("parts")).where(F.col("parts") > 1)
