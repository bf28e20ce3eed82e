"""Exact Jaccard join of word-shingle sets by parity sketches, and its connected components.

Sets.  A text's set holds the hashes of its distinct runs of SHINGLE words.  Texts with equal
sets form a class; all further work is on classes, so copies cost nothing.

Parity sketches.  XOR of token hashes cancels what two sets share.  If two sets with sizes a
and b reach similarity t, their symmetric difference is at most (a + b) * (1 - t) / (1 + t),
and no more bits of two parity sketches, and no more blocks of two partitioned ones, can differ.

Size bands and pigeonhole.  A band covers sizes from 2**j to 2**(j+1), and partners up to 1/t
above.  In a band every token falls into one of `blocks` blocks by its hash; the XOR of a block's
tokens is its parity.  A set of size a has at most D = a * (1/t - 1) differing tokens to any
partner, so at least `blocks` - D blocks agree.  By the prefix principle it is enough that each
set shows its first D + 1 blocks in an order all sets share.  Blocks whose key (band, block,
parity) occurs once in the corpus come first: they cannot agree with anything, so most texts
show nothing, also if they share a passage with many.  Then come blocks with many tokens.

Candidates.  Keys that occur more than once are found by packed hash ranges.  Within a key every class is compared with one
leader, so a group of g near copies costs g pairs.  Keys whose classes then lie in different
components elect further leaders, each compared with the classes outside its component, as
long as this halves the pairs left.  Last, all pairs left within a key are compared, but only
those of different components for which the sizes, the sketches and the triangle inequality of
the Jaccard distance leave a chance; the test is part of the join, so other pairs never become rows.
Pairs are first tested by
the Hamming distance of 1024-bit parity sketches, then exactly.

Null text, or text without words: no set, linked with nothing.  Fewer than SHINGLE words: the
whole sequence is the one element.  Null and repeated ids are allowed; an empty table gives an
empty result.  A class is known by a 64-bit hash of its set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel.llm.components import components
from flowintel.llm.shared import contains, pack_hashes, PACKED, ranges_for, repeated, shared_folder
from flowintel.llm.text import Words, grams, mix, slices
from flowintel.session import checkpointed, compacted, join_per_key, tasks_for

SHINGLE = 5
PERCENT = 80
SKETCH_WORDS = 16
SKETCH = [f"w{i}" for i in range(SKETCH_WORDS)]
SETS_AT_ONCE = 2000
# Pairs to compare in one go, as a multiple of the members of all keys; beyond it further leaders are tried first.
PAIRS_PER_MEMBER = 4
# Leaders that such a key elects in one turn.
LEADERS = 8
# What the tokens and sketch of a set count for among the rows of a task.
WIDE_ROW = 10


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text with words."""
    for first, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        whole = grams(words.hash, n)
        bounds = words.bounds.tolist()
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= n:
                yield first + i, np.unique(whole[a : b - n + 1])
            elif b > a:
                short = grams(words.hash[a:b], b - a)
                yield first + i, mix(short ^ np.uint64(b - a))


def set_id(tokens: np.ndarray) -> int:
    """64-bit hash of a set, from its parity, its sum and its size."""
    with np.errstate(over="ignore"):
        parts = np.array([np.bitwise_xor.reduce(tokens), tokens.sum(), len(tokens)], np.uint64)
    return int(grams(mix(parts), 3)[0].astype(np.int64))


def band_blocks(band: int, percent: int = PERCENT) -> int:
    """Number of blocks of a band: a fifth more than the differences its largest sets may have."""
    largest = (2 << band) * 100 / percent
    return max(1, floor(1.2 * largest * (100 - percent) / percent) + 1)


def block_keys(tokens: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each band of a set: keys (band, block, parity), tokens in each block, and how many keys to show."""
    size = len(tokens)
    shown = size * (100 - percent) // percent + 1
    own = size.bit_length() - 1
    # a set near the lower edge may have smaller partners in the band below
    for band in [own - 1, own] if own and size * percent < 100 * (1 << own) else [own]:
        blocks = band_blocks(band, percent)
        block = (mix(tokens ^ np.uint64(band + 1)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        counts = np.bincount(block, minlength=blocks)
        full = np.flatnonzero(counts)
        parity = np.zeros(blocks, np.uint64)
        parity[full] = np.bitwise_xor.reduceat(tokens[order], (np.cumsum(counts) - counts)[full])
        yield mix(parity + mix(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40))), counts, shown


def first_keys(keys: np.ndarray, counts: np.ndarray, shown: int, common: np.ndarray) -> np.ndarray:
    """The common ones among the first `shown` keys, rare keys first, then blocks with many tokens."""
    left = shown - int((~common).sum())
    if left <= 0:
        return keys[:0]
    keys, counts = keys[common], counts[common]
    return keys[np.lexsort((keys, -counts))[:left]]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS * 64 bits; each token flips one."""
    spread = mix(tokens ^ np.uint64(0x5DEECE66D))
    bits = np.bincount((spread % np.uint64(SKETCH_WORDS * 64)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def describe_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text, the last column, by the set's id (null: no set) and size."""
    for batch in batches:
        ids, sizes = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
        for row, tokens in shingle_sets(batch.column(batch.num_columns - 1)):
            ids[row], sizes[row] = set_id(tokens), len(tokens)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(ids, pa.int64()), pa.array(sizes)],
            names=[*batch.schema.names[:-1], "set_id", "n_shingles"])


def _set_details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            found = [(set_id(t), t.view(np.int64), parity_sketch(t))
                     for _, t in shingle_sets(batch.column(0).slice(part, 500))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64())),
                 pa.array([x[2] for x in found], pa.list_(pa.int64()))], names=["set_id", "tokens", "sketch"])


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.col(text_col).cast("string").alias("_text")


def shared_keys(docs: DataFrame, text_col: str, percent: int) -> DataFrame:
    """(key, set_id) of all keys that at least two classes show."""
    spark = docs.sparkSession
    folder, ranges = shared_folder(spark), ranges_for(docs, text_col, 0.4)

    def sets_of(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        for _, tokens in shingle_sets(batch.column(0)):
            own = set_id(tokens)
            if own not in seen:  # copies met in one task show their keys once
                seen.add(own)
                yield own, tokens

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, tokens in sets_of(batch, seen):
                for keys, counts, _ in block_keys(tokens, percent):
                    yield keys[counts > 0]

        yield from pack_hashes(batches, keys_of, ranges)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in range(0, batch.num_rows, SETS_AT_ONCE):
                sets = [(own, *band) for own, tokens in sets_of(batch.slice(part, SETS_AT_ONCE), seen)
                        for band in block_keys(tokens, percent)]
                if not sets:
                    continue
                common = contains(folder, "repeated", ranges, np.concatenate([keys for _, keys, _, _ in sets]))
                common = np.split(common, np.cumsum([len(keys) for _, keys, _, _ in sets])[:-1])
                shown = [first_keys(keys, counts, most, known | (counts == 0))
                         for (_, keys, counts, most), known in zip(sets, common)]
                owner = np.repeat(np.array([own for own, *_ in sets]), [len(keys) for keys in shown])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shown).view(np.int64)), pa.array(owner)], names=["key", "set_id"])

    texts = docs.select(_text(docs, text_col))
    repeated(texts.mapInArrow(pack, PACKED), folder)
    return texts.mapInArrow(show, "key bigint, set_id bigint").distinct()


def similar(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, distance, exact) of pairs of classes; a distance that is not exact is a lower bound."""
    # sets are wide rows, and each join reads all of them, however few the pairs are
    tasks = tasks_for(max(pairs.count(), WIDE_ROW * sets.count()))
    sketches = sets.select("set_id", "sketch", F.size("tokens").alias("_n"))
    left = sketches.toDF("a", "_sa", "_na")
    right = sketches.toDF("b", "_sb", "_nb")
    flips = F.zip_with("_sa", "_sb", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    hamming = F.aggregate(flips, F.lit(0), lambda s, x: s + x)
    sized = pairs.join(left, "a").coalesce(tasks).join(right, "b").select("a", "b", "_na", "_nb", hamming.alias("_h"))
    total = F.col("_na") + F.col("_nb")
    # the symmetric difference of a pair at the limit, times (100 + percent)
    far = (F.col("_h") * (100 + percent) > total * (100 - percent)) | (
        F.least("_na", "_nb") * 100 < F.greatest("_na", "_nb") * percent)
    tested = checkpointed(sized.withColumn("_far", far)).coalesce(tasks)
    bound = F.greatest(2 * F.col("_h") / (total + F.col("_h")), 1 - F.least("_na", "_nb") / F.greatest("_na", "_nb"))
    rejected = tested.where("_far").select("a", "b", F.lit(False).alias("linked"), bound.alias("distance"), F.lit(False).alias("exact"))
    tokens = sets.select("set_id", "tokens")
    near = tested.where("not _far").join(tokens.toDF("a", "_ta"), "a").coalesce(tasks).join(tokens.toDF("b", "_tb"), "b")
    near = near.select("a", "b", "_na", "_nb", F.size(F.array_intersect("_ta", "_tb")).alias("_both"))
    exact = near.select("a", "b", similar(F.col("_both"), F.col("_na"), F.col("_nb"), percent).alias("linked"),
                        (1 - F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("distance"), F.lit(True).alias("exact"))
    return checkpointed(rejected.unionByName(exact)).coalesce(tasks)


def _details(docs: DataFrame, text_col: str, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """Tokens and sketch of the given classes, from the text of one document each."""
    tasks = tasks_for(classes.count())
    wanted = classes.join(ids.select(F.col("id").alias("set_id")), "set_id", "left_semi").select(
        F.col("first_key").alias("_key")).coalesce(tasks).distinct().coalesce(tasks)
    # texts whose hash is wanted; a text with the same hash by chance only adds a class nobody asks for
    texts = join_per_key(docs.select(_text(docs, text_col)), wanted, F.xxhash64("_text") == F.col("_key"), "inner")
    found = texts.select("_text").mapInArrow(_set_details, "set_id bigint, tokens array<bigint>, sketch array<bigint>")
    return compacted(found.dropDuplicates(["set_id"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable), set_id (class), component_key (one class of the component)."""
    rows = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_key"),
                                    _text(docs, text_col)).mapInArrow(
        describe_sets, f"doc_id {docs.schema[id_col].dataType.simpleString()}, _key bigint, set_id bigint, n_shingles bigint"))
    classes = compacted(rows.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"), F.min("_key").alias("first_key")))
    roots = class_roots(docs, classes, text_col, percent)
    known = classes.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "set_id", F.coalesce("root", "set_id").alias("component_key"), "first_id")
    known = compacted(known)
    first = known.groupBy("component_key").agg(F.min("first_id").alias("component_id"))
    labels = compacted(known.join(first, "component_key").select(
        F.col("set_id").alias("_set"), "component_key", "component_id"))
    labelled = rows.join(labels, F.col("set_id") == F.col("_set"), "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                           "set_id", "component_key")


def class_roots(docs: DataFrame, classes: DataFrame, text_col: str, percent: int) -> DataFrame:
    """(node, root) of every class that has a link to another one."""
    keys = compacted(shared_keys(docs, text_col, percent))
    leaders = keys.groupBy("key").agg(F.min("set_id").alias("leader"), F.count("*").alias("_n")).where("_n > 1")
    stars = compacted(keys.join(leaders.select("key", "leader"), "key").where("set_id <> leader"))
    tried = compacted(stars.select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct())
    tasks = tasks_for(stars.count())
    ids = tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _details(docs, text_col, classes, ids)
    star = compare(tried, sets, percent)
    links = star.where("linked").select("a", "b")
    roots = components(links)
    judged = compacted(stars.join(
        star.withColumnsRenamed({"a": "leader", "b": "set_id"}), ["leader", "set_id"]).select("key", "set_id", "distance", "exact")
        .coalesce(tasks).join(sets.select("set_id", F.size("tokens").alias("size")), "set_id"))
    before = None
    columns = ["set_id", "distance", "exact", "size", "root", *SKETCH]
    for turn in count(1):
        named = compacted(judged.join(roots, F.col("set_id") == F.col("node"), "left").select(
            *judged.columns, F.coalesce("root", "set_id").alias("root")))
        # only keys whose members lie in several components need more comparisons
        split = named.groupBy("key", "root").agg(F.count("*").alias("n")).coalesce(tasks).groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("_squares")).where("n * n > _squares")
        split = compacted(split)
        left = split.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("_squares")) / 2).alias("pairs"), F.sum("n").alias("n")).first()
        if not left["pairs"]:
            return roots
        named = named.join(split.select("key"), "key").coalesce(tasks).join(
            sets.select("set_id", *[F.col("sketch")[i].alias(w) for i, w in enumerate(SKETCH)]), "set_id").coalesce(tasks)
        sides = [named.select("key", *[F.col(c).alias(f"_{c}_{side}") for c in columns]) for side in "ab"]
        if left["pairs"] <= PAIRS_PER_MEMBER * left["n"] or before and 2 * left["pairs"] > before:
            break
        before = left["pairs"]
        draw = F.xxhash64(F.lit(turn), "key", "set_id")
        chosen = named.groupBy("key", F.pmod(draw, F.lit(LEADERS)).alias("_slot")).agg(
            F.min_by(F.struct(*columns), draw).alias("_leader"))
        leaders = chosen.select("key", *[F.col(f"_leader.{c}").alias(f"_{c}_b") for c in columns]).coalesce(tasks)
        more = possible_pairs(sides[0], leaders, percent)
        tried, links, roots = _linked(more, tried, links, roots, sets, percent)
    return _linked(possible_pairs(*sides, percent, once=True), tried, links, roots, sets, percent)[2]


def possible_pairs(one: DataFrame, other: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """(a, b) of members of one key in different components that sizes, distances to the leader and sketches do not rule out.

    All is tested while joining, so that only such pairs become rows.  With `once` both sides hold the same members.
    """
    limit = (100 - percent) / 100 + 1e-9
    both = one.join(other, "key").where("_set_id_a < _set_id_b" if once else "_set_id_a <> _set_id_b").where("_root_a <> _root_b").where(
        F.least("_size_a", "_size_b") * 100 >= F.greatest("_size_a", "_size_b") * percent)
    for x, y in ("ab", "ba"):  # a rejected pair's distance may be too small, never too large
        both = both.where(f"not (_exact_{x} and _distance_{y} - _distance_{x} > {limit})")
    flips = " + ".join(f"bit_count(_{w}_a ^ _{w}_b)" for w in SKETCH)
    both = both.where(f"({flips}) * {100 + percent} <= (_size_a + _size_b) * {100 - percent}")
    return both.select(F.least("_set_id_a", "_set_id_b").alias("a"), F.greatest("_set_id_a", "_set_id_b").alias("b"))


def _linked(
    more: DataFrame, tried: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, percent: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tried, links, roots) after the pairs `more` that were not tried before are compared."""
    more = compacted(more.distinct().join(
        tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if more.isEmpty():
        return tried, links, roots
    found = compare(more, sets, percent).where("linked").select("a", "b")
    tried, links = tried.unionByName(more), links.unionByName(found)
    return tried, links, roots if found.isEmpty() else components(links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents with their columns; of every component one row stays, that with the smallest id.

    Texts without words all stay.  Rows with a null or repeated id stay once per component.
    """
    found = checkpointed(near_duplicates(docs))
    several = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    gone = found.where("set_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    unclear = checkpointed(several)
    if unclear.isEmpty():
        return join_per_key(docs, gone, docs["doc_id"] == F.col("_id"), "left_anti").select(docs.columns)
    single = join_per_key(docs, unclear.unionByName(gone), docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti")
    rows = docs.join(unclear, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").withColumn("_row", F.struct(*docs.columns))
    described = rows.select("_row", _text(rows, "text")).mapInArrow(
        describe_sets, f"_row {rows.schema['_row'].dataType.simpleString()}, set_id bigint, n_shingles bigint")
    # a component belongs here if its smallest id is one of these, or if none of its rows has an id
    own = found.join(unclear, found["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    kept = own.where("component_id is null or doc_id = component_id").select(
        F.col("set_id").alias("_set"), "component_key").distinct()
    again = described.join(kept, F.col("set_id") == F.col("_set"))
    chosen = again.groupBy("component_key").agg(F.min(F.to_json("_row")).alias("_least"), F.first("_row").alias("_row"))
    empty = described.where("set_id is null")
    back = [F.col("_row").getField(c).alias(c) for c in docs.columns]
    return single.select(docs.columns).unionByName(chosen.select(*back)).unionByName(empty.select(*back))
