"""Order MinHash fingerprints: sensitive to edit distance, not only to shared content.

A text's k-mers are runs of K code points, numbered by occurrence, so that repetitions count.
For each of SIZE hash functions the TUPLE smallest (k-mer, number) pairs are chosen and put
back into text order; the hash of that tuple is one entry.  Two texts agree in an entry only
if the same k-mers are smallest and stand in the same order.  The likeness of two
fingerprints is the share of equal entries.

Null text counts as empty.  The fingerprint of an empty text is empty; two of them have
likeness 1, an empty and another one 0.  A text shorter than K is one k-mer.  Equal texts have
equal fingerprints.  Long texts are read in blocks.  An empty table gives an empty result.

Each document is also compared with an edited form of itself, whose end comes from the next
document in falling order of id (ties by text hash; null ids last; after the last one, the
first).  Neighbours are found without a global sort: ids are cut into ranges of BUCKET, the
next text within a range comes from a window, that of a range's last row from the first row
of the following range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel.llm.text import grams, mix
from flowintel.session import checkpointed, join_per_key

K = 10
TUPLE = 2
SIZE = 32
BUCKET = 256
BLOCK = 4096
_GOLD = np.uint64(0x9E3779B97F4A7C15)
FACTORS = mix(np.arange(1, SIZE + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)


def numbered(keys: np.ndarray) -> np.ndarray:
    """For each key, how many equal ones stand before it."""
    number = np.zeros(len(keys), np.uint64)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        twice = np.unique(twice)
        slot = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        at = np.flatnonzero(twice[slot] == keys)
        order = at[np.argsort(slot[at], kind="stable")]
        groups = slot[order]
        heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        first = np.repeat(heads, np.diff(np.append(heads, len(groups))))
        number[order] = (np.arange(len(order)) - first).astype(np.uint64)
    return number


def fingerprint(text: str) -> str:
    """SIZE entries of 8 hexadecimal digits."""
    if not text:
        return ""
    chars = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    keys = grams(chars, min(K, len(chars)))
    pairs = mix(keys + numbered(keys) * _GOLD)
    least = np.full((SIZE, TUPLE), ~np.uint64(0))
    where = np.full((SIZE, TUPLE), -1)
    rows = np.arange(SIZE)
    for start in range(0, len(pairs), BLOCK):
        hashed = pairs[None, start : start + BLOCK] * FACTORS[:, None]
        for _ in range(min(TUPLE, hashed.shape[1])):
            at = hashed.argmin(axis=1)
            value = hashed[rows, at]
            hashed[rows, at] = ~np.uint64(0)
            worst = least.argmax(axis=1)
            better = value < least[rows, worst]
            least[rows[better], worst[better]] = value[better]
            where[rows[better], worst[better]] = at[better] + start
    where.sort(axis=1)
    chosen = np.where(where >= 0, keys[where], np.uint64(0))
    entry = np.zeros(SIZE, np.uint64)
    for i in range(TUPLE):
        entry = mix(entry * _GOLD + chosen[:, i])
    return (entry >> np.uint64(32)).astype(">u4").tobytes().hex()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the fingerprint of the last column."""
    for batch in batches:
        prints = pa.array([fingerprint(x.as_py() or "") for x in batch.column(batch.num_columns - 1)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, "_print"])


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """The frame with the fingerprint of a text column."""
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(*rest, F.col(text_col).cast("string").alias(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_fingerprints, f"{schema}, _print string").withColumnRenamed("_print", name)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints."""
    places = F.sequence(F.lit(0), F.lit(SIZE - 1))
    same = F.filter(places, lambda i: F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.size(same) / SIZE)


def _following(buckets: DataFrame) -> DataFrame:
    """(_bucket, _from): the next bucket of each in rising order, the first one after the last."""
    groups = buckets.withColumn("_super", F.shiftright("_bucket", 12))
    inside = groups.withColumn("_next", F.lead("_bucket").over(Window.partitionBy("_super").orderBy("_bucket")))
    supers = groups.groupBy("_super").agg(F.min("_bucket").alias("_first"))
    order = Window.orderBy("_super")  # one row per BUCKET * 4096 ids
    wrapped = F.coalesce(F.lead("_first").over(order), F.first("_first").over(Window.orderBy("_super").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)))
    supers = supers.select("_super", wrapped.alias("_wrapped"))
    return inside.join(supers, "_super").select("_bucket", F.coalesce("_next", "_wrapped").alias("_from"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    falling = -F.col(id_col).cast("bigint")
    nameless = F.lit(1 << 60) + F.pmod(F.xxhash64(text_col), F.lit(1024))
    bucket = F.coalesce(F.floor(falling / BUCKET), nameless).cast("bigint")
    plain = docs.select(F.col(id_col).alias("doc_id"), bucket.alias("_bucket"), F.xxhash64(text).alias("_tie"),
                        text.alias("text"))
    dealt = with_fingerprint(plain, "text", "fingerprint").repartition("_bucket")
    order = Window.partitionBy("_bucket").orderBy((-F.col("doc_id")).asc(), "_tie")
    placed = dealt.withColumns({"_next_text": F.lead("text").over(order), "_next_print": F.lead("fingerprint").over(order)})
    # the first row of each range goes to the range before it; it is found by ids alone, so texts are dealt out once
    firsts = checkpointed(plain.groupBy("_bucket").agg(F.min(F.struct(-F.col("doc_id"), "_tie")).alias("_top")))
    wanted = _following(firsts.select("_bucket")).join(firsts.withColumnRenamed("_bucket", "_from"), "_from").select(
        F.col("_bucket").alias("_to"), F.col("_from"), F.col("_top._tie").alias("_top_tie"),
        (-F.col("_top").getField(firsts.schema["_top"].dataType.names[0])).alias("_top_id"))
    same = (F.col("_bucket") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_top_id")) & (F.col("_tie") == F.col("_top_tie"))
    tops = join_per_key(plain, wanted, same, "inner").select(F.col("_to").alias("_bucket"), "text").dropDuplicates(["_bucket"])
    heads = with_fingerprint(tops, "text", "_head_print").withColumnRenamed("text", "_head_text")
    whole = placed.join(heads, "_bucket", "left")
    next_text = F.coalesce("_next_text", "_head_text")
    size = F.length("text").cast("bigint")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (size - cut).cast("int")), F.substr(next_text, F.lit(1), cut))
    ready = whole.select("doc_id", size.alias("n_chars"), "fingerprint",
                         F.coalesce("_next_print", "_head_print").alias("_next_print"), edited.alias("_edited"))
    done = with_fingerprint(ready, "_edited", "edited_fingerprint")
    return done.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next"))
