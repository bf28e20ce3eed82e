"""Mixing of sources to target weights along a time-varying curriculum.

Every source gets a target of words from its weight, at most `max_passes` times its size.
Its schedule says how its share changes over training time t in [0, 1]: the weight at t is
proportional to 1 + slope * (2t - 1).  The integral of the schedule is the cumulative
demand, target * (t + slope * (t*t - t)).  The documents of a source stand in a fixed
pseudo-random order; the demand is inverted at the words before a document, which gives its
training position.  Pass two follows pass one.  The document at the end is taken in part.

Sizes are words; null text has none.  Null sources form one source, ranked last.  Documents
without words take nothing and have no position.  Rows with the same id and text are
interchangeable.  An empty table gives an empty result.  Extra columns are ignored.

Running totals use hash buckets: sums per (source, bucket), a running sum over at most
2 ** BUCKET_BITS buckets of a source, then one over the rows of a bucket.  No task holds a source.
The windows over sources hold one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel.llm.words import word_count
from flowintel.session import checkpointed

WEIGHTS = (3, 1, 2)
SLOPES = (0.5, -0.5, 0.0)
SHARE = 1.5
MAX_PASSES = 2
BUCKET_BITS = 12


def source_key(source: Column) -> Column:
    """Source as non-null text in which null differs from every name and sorts last."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _pick(values: tuple, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def source_targets(
    sources: DataFrame, weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE,
    max_passes: int = MAX_PASSES,
) -> DataFrame:
    """Adds target and slope to (_src, source_size).

    Resharing the excess by weight until no source is above its limit ends where the target
    is min(limit, level * weight).  Sorted by limit per weight, the sources at their limit are
    a prefix, so running sums give the level: the first below its limit, which is the largest.
    """
    ranked = sources.withColumn("_place", F.row_number().over(Window.orderBy("_src")) - 1).withColumns({
        "_weight": _pick(weights, F.col("_place")), "slope": _pick(slopes, F.col("_place"))})
    by_limit = Window.orderBy(F.col("source_size") / F.col("_weight"), "_src")
    whole = Window.partitionBy()
    running = ranked.withColumns({
        "_full": F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_open": F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(whole),
    })
    # the level if this source and all behind it stay below their limits
    level = (F.col("_all") * F.lit(float(share)) - F.col("_full") * max_passes) / F.col("_open")
    below = level * F.col("_weight") < F.col("source_size") * max_passes
    levelled = running.withColumn("_level", level).withColumn("_level", F.max(F.when(below, F.col("_level"))).over(whole))
    target = F.least(F.col("source_size") * F.lit(float(max_passes)), F.col("_level") * F.col("_weight"))
    return levelled.select("_src", "source_size", F.coalesce(target, F.col("source_size") * float(max_passes)).alias("target"), "slope")


def position_of(words: Column, target: Column, slope: Column) -> Column:
    """Training time at which the demand reaches this many words."""
    share = words / target
    flat = 1 - slope
    root = (F.sqrt(flat * flat + 4 * slope * share) - flat) / (2 * slope)
    return F.when(target > 0, F.when(slope == 0, share).otherwise(root))


def curriculum_mix(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
    weights: tuple = WEIGHTS, slopes: tuple = SLOPES, share: float = SHARE, max_passes: int = MAX_PASSES,
) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken, taken_first, position, repeat_position by position."""
    sized = checkpointed(docs.select(
        F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("_src"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_hash"),
    ).withColumn("_order", F.xxhash64("doc_id", "text_hash")).withColumn("_bucket", F.shiftright("_order", 64 - BUCKET_BITS)))
    buckets = sized.groupBy("_src", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_src", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    totals = buckets.groupBy("_src").agg(F.sum("_words").alias("source_size"))
    offsets = offsets.join(source_targets(totals, weights, slopes, share, max_passes), "_src")
    inside = (Window.partitionBy("_src", "_bucket").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.join(offsets, ["_src", "_bucket"]).withColumn(
        "_start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = F.floor("target")

    def taken(number: int) -> Column:
        left = cut - number * F.col("source_size") - F.col("_start")
        return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint")

    def position(number: int) -> Column:
        start = number * F.col("source_size") + F.col("_start")
        return F.when(taken(number) > 0, position_of(start, F.col("target"), F.col("slope")))

    passes = list(range(max_passes))
    every = taken(0)
    for number in passes[1:]:
        every = every + taken(number)
    return placed.select(
        "doc_id", "text_hash", "size", "source_size", "target", every.alias("taken"), taken(0).alias("taken_first"),
        position(0).alias("position"), position(1).alias("repeat_position") if max_passes > 1 else F.lit(None).cast("double").alias("repeat_position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents of the mix with their columns, once per pass taken, sorted by training position.

    A document that the cut takes in part stays whole if at least half of its words are
    taken, and goes otherwise.  Rows with the same id and text are one
    document here: each of them gets every turn of the group.
    """
    mix = curriculum_mix(docs)
    first = F.when((F.col("size") > 0) & (2 * F.col("taken_first") >= F.col("size")), F.col("position"))
    second = F.when((F.col("size") > 0) & (2 * (F.col("taken") - F.col("taken_first")) >= F.col("size")),
                    F.col("repeat_position"))
    turns = mix.groupBy("doc_id", "text_hash").agg(F.min(first).alias("_first"), F.min(second).alias("_second"))
    turns = turns.where("_first is not null or _second is not null").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_first", "_second")
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash"))
    rows = docs.join(turns, same).withColumn("_turn", F.explode(F.array_compact(F.array("_first", "_second"))))
    return rows.orderBy("_turn", "doc_id").select(*[rows[c] for c in docs.columns])
