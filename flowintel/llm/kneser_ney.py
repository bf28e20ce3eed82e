"""Interpolated modified Kneser-Ney bigram model in sorted hash arrays.

Tokens are the words in lower case (A-Z) and one end mark per text; a start mark is context
only.  Every task counts its own bigrams and packs them by the hash range of the context, so
all counts of a context meet in one range.  A range's task adds them up, forms the discounts'
counts, and writes sorted arrays: bigram keys with counts, contexts with totals and numbers of
successors seen once, twice, more often.  Continuation counts (distinct contexts of a word) go
through a second exchange by the word's range, with the word's plain count.  Scoring maps the
arrays into memory; queries are sorted first, so that they walk through the files.

Null text counts as empty: one token, the end mark.  Without training text all counts are 0;
the base score then divides by 0.1 alone.  Null ids are training rows.  Repeated rows count
as often as they occur.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel.llm.shared import PACKED, RANGE_ENTRIES, cuts, find, ranges_for, shared_folder, write_array
from flowintel.llm.text import Words, mix, slices, word_hash

END = np.uint64(word_hash("\x00end"))
START = np.uint64(word_hash("\x00start"))
ADD = 0.1
FOLDS = 10


def held_out(id_col: str, folds: int = FOLDS) -> Column:
    """Whether a row is kept out of training; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, text) of all tokens of a run of texts; the end mark closes each text."""
    words = Words(data, offsets, lower=True)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), words.counts() + 1)
    last = words.bounds[1:] + np.arange(n)
    token = np.empty(len(words.hash) + n, np.uint64)
    token[last] = END
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner] = words.hash
    context = np.empty(len(token), np.uint64)
    context[1:] = token[:-1]
    context[last + 1 - (words.counts() + 1)] = START
    return token, context, text


def bigram_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Keys whose order keeps that of the context's upper half, so they stay in its range."""
    return (context & np.uint64(0xFFFFFFFF00000000)) | (mix(token + mix(context)) >> np.uint64(32))


def _added(keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct key tuples in order of the first key, with summed counts."""
    if not len(counts):
        return keys, counts
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(counts), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), np.add.reduceat(counts[order], at)


def _packed(parts: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
    """One binary per range: the lengths of its arrays, then their bytes."""
    rows = [np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)
            for _, arrays in parts]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array(rows, pa.binary())],
                                      names=["range", "packed"])


def _unpacked(packed: bytes, kinds: list[type]) -> list[np.ndarray]:
    sizes = np.frombuffer(packed, np.int64, len(kinds))
    at = np.cumsum([8 * len(kinds), *sizes])
    return [np.frombuffer(packed[at[i] : at[i + 1]], kind) for i, kind in enumerate(kinds)]


def count_bigrams(batches: Iterator[pa.RecordBatch], ranges: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Per range: contexts, number of successors of each, successors, counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def send() -> pa.RecordBatch:
        context = np.concatenate([c for c, _ in held]) if held else np.zeros(0, np.uint64)
        token = np.concatenate([t for _, t in held]) if held else np.zeros(0, np.uint64)
        (context, token), counts = _added((context, token), np.ones(len(context), np.int64))
        at = cuts(context, ranges)
        parts = []
        for i in range(ranges):
            a, b = at[i], at[i + 1]
            if b > a:
                own, successors = np.unique(context[a:b], return_counts=True)
                parts.append((i, [own, successors.astype(np.uint32), token[a:b], counts[a:b].astype(np.uint32)]))
        return _packed(parts)

    for batch in batches:
        for _, data, offsets in slices(batch.column(0)):
            token, context, _ = token_stream(data, offsets)
            held.append((context, token))
            size += len(token)
            if size >= limit:
                yield send()
                held.clear()
                size = 0
    yield send()


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, kept inside [0, count]."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(i - (i + 1) * y * b / a, 0.05), i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def discount_of(counts: np.ndarray, by_count: list[float]) -> np.ndarray:
    return np.array([0.0, *by_count])[np.minimum(counts, 3).astype(np.int64)]


@dataclass(frozen=True)
class Model:
    """Folder of the arrays and the totals of a trained model."""

    folder: str
    ranges: int
    tokens: int
    distinct: int
    bigram_discounts: tuple
    word_discounts: tuple
    bigram_types: int
    continuation_classes: tuple


def train(docs: DataFrame, text_col: str = "text", limit: int = RANGE_ENTRIES) -> Model:
    """Model of all given texts."""
    spark = docs.sparkSession
    folder, ranges = shared_folder(spark), ranges_for(docs, text_col, 0.6)
    texts = docs.select(F.col(text_col).cast("string"))
    local = texts.mapInArrow(lambda batches: count_bigrams(batches, ranges, limit), PACKED)

    def by_context(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpacked(x, [np.uint64, np.uint32, np.uint64, np.uint32]) for x in table["packed"].to_pylist()]
        context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        token = np.concatenate([p[2] for p in parts])
        (context, token), counts = _added((context, token), np.concatenate([p[3] for p in parts]).astype(np.int64))
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        few = np.minimum(counts, 3)
        name = key[0].as_py()
        stats = np.stack([np.add.reduceat(counts, heads)] + [np.add.reduceat((few == i).astype(np.int64), heads) for i in (1, 2, 3)], axis=1)
        write_array(folder, f"context-{name}", context[heads])
        write_array(folder, f"stats-{name}", stats)
        pairs = bigram_key(context, token)
        order = np.argsort(pairs)
        write_array(folder, f"pair-{name}", pairs[order])
        write_array(folder, f"count-{name}", np.minimum(counts[order], 0xFFFFFFFF).astype(np.uint32))
        (word,), times = _added((token,), counts)
        _, types = _added((token,), np.ones(len(token), np.int64))
        at = cuts(word, ranges)
        out = _packed([(i, [word[at[i] : at[i + 1]], types[at[i] : at[i + 1]].astype(np.uint32), times[at[i] : at[i + 1]].astype(np.uint32)])
                       for i in range(ranges) if at[i + 1] > at[i]])
        sums = _packed([(-1, [np.bincount(np.minimum(counts, 5), minlength=6)[1:5]])])
        return pa.Table.from_batches([out, sums])

    reduced = local.groupBy("range").applyInArrow(by_context, PACKED)

    def by_word(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        if name < 0:
            total = sum(np.frombuffer(x[8:], np.int64) for x in table["packed"].to_pylist())
            return pa.table({"kind": ["bigrams"], "n": [total.tolist()]}, schema=schema)
        parts = [_unpacked(x, [np.uint64, np.uint32, np.uint32]) for x in table["packed"].to_pylist()]
        word = np.concatenate([p[0] for p in parts])
        (found,), types = _added((word,), np.concatenate([p[1] for p in parts]).astype(np.int64))
        _, times = _added((word,), np.concatenate([p[2] for p in parts]).astype(np.int64))
        write_array(folder, f"word-{name}", found)
        write_array(folder, f"types-{name}", types)
        write_array(folder, f"times-{name}", times)
        few = np.bincount(np.minimum(types, 5), minlength=6)[1:5]
        classes = np.bincount(np.minimum(types, 3), minlength=4)[1:4]
        return pa.table({"kind": ["words"], "n": [[*few.tolist(), int(types.sum()), int(times.sum()), len(found), *classes.tolist()]]}, schema=schema)

    schema = pa.schema([("kind", pa.string()), ("n", pa.list_(pa.int64()))])
    sums = reduced.groupBy("range").applyInArrow(by_word, "kind string, n array<bigint>")
    totals = {"bigrams": [0] * 4, "words": [0] * 10}
    cells = sums.select("kind", F.posexplode("n").alias("i", "n")).groupBy("kind", "i").agg(F.sum("n").alias("n"))
    for row in cells.collect():  # at most 14 rows
        totals[row["kind"]][row["i"]] = row["n"]
    w = totals["words"]
    return Model(folder, ranges, w[5], w[6], tuple(discounts(totals["bigrams"])), tuple(discounts(w[:4])), w[4], tuple(w[7:10]))


def _lookup(model: Model, prefix: str, value: str, keys: np.ndarray, width: int = 0) -> np.ndarray:
    """Values of distinct keys, 0 where the model has none."""
    from flowintel.llm.shared import read_array

    out = np.zeros((len(keys), width) if width else len(keys), np.int64)
    for i, where, slot in find(model.folder, prefix, model.ranges, keys):
        out[where] = read_array(model.folder, f"{value}-{i}")[slot]
    return out


def token_scores(model: Model, token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count in training, log10 probability) of each token after its context."""
    words, back = np.unique(token, return_inverse=True)
    times = _lookup(model, "word", "times", words)
    types = _lookup(model, "word", "types", words)
    all_types = max(model.bigram_types, 1)
    left = sum(d * n for d, n in zip(model.word_discounts, model.continuation_classes)) / all_types
    uniform = 1.0 / (model.distinct + 1)
    if not model.bigram_types:
        left = 1.0
    lower = (np.maximum(types - discount_of(types, list(model.word_discounts)), 0) / all_types + left * uniform)[back]
    contexts, own = np.unique(context, return_inverse=True)
    stats = _lookup(model, "context", "stats", contexts, 4)
    total = np.maximum(stats[:, 0], 1)
    weight = np.where(stats[:, 0] > 0, stats[:, 1:] @ np.array(model.bigram_discounts) / total, 1.0)
    pairs, again = np.unique(bigram_key(context, token), return_inverse=True)
    seen = _lookup(model, "pair", "count", pairs)
    kept = np.maximum(seen - discount_of(seen, list(model.bigram_discounts)), 0)[again]
    return times[back], np.log10(kept / total[own] + weight[own] * lower)


def score(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """`keys`, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""
    base = model.tokens + ADD * (model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in slices(batch.column(batch.num_columns - 1)):
                token, context, text = token_stream(data, offsets)
                times, scores = token_scores(model, token, context)
                n = len(offsets) - 1
                parts.append((
                    np.bincount(text, minlength=n), np.bincount(text[times > 0], minlength=n), np.full(n, model.tokens),
                    np.bincount(text, np.log10((times + ADD) / base), minlength=n), np.bincount(text, scores, minlength=n)))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
            columns.append(10 ** (-columns[4] / np.maximum(columns[0], 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], names=[
                *batch.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(*keys, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                                "score double, perplexity double")
