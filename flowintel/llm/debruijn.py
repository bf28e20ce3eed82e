"""Removal of passages that occur elsewhere, over the De Bruijn graph of repeated word runs.

A run of WINDOW words is an edge between its first and its last WINDOW - 1 words.  Edges that
occur once in the corpus cannot belong to a repeated passage; the others are found by packed
hash ranges and stay as sorted arrays in the shared folder.  A text then is a walk over
repeated edges, in pieces.  A piece is cut where the graph branches or a passage begins or
ends: at an edge whose predecessor or successor differs among its occurrences, which a second
exchange finds.  What lies between two cuts is one path without branches, the same in each
text that holds it, so a whole path compacts to one hash without pointer jumping.  A third
exchange verifies that a path occurs at two or more source coordinates; its words then go.

Words are compared unchanged.  Null text counts as empty: no words, nothing removed, the
digest of the empty text.  Fewer than WINDOW words: nothing is removed.  Repeated rows are
copies of each other and lose all their words.  Ids only label the rows and may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.llm.shared import (
    PACKED, RANGE_ENTRIES, contains, cuts, find, pack_hashes, ranges_for, read_array, repeated, shared_folder, write_array)
from flowintel.llm.text import Words, grams, grams_long, mix, slices
from flowintel.session import checkpointed

WINDOW = 35
JOINS, PARTS = 1, 2


def text_edges(column: pa.Array, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, Words, np.ndarray, np.ndarray]]:
    """(first row, offsets, words, start word of each edge, its hash) of runs of whole texts."""
    for first, data, offsets in slices(column):
        words = Words(data, offsets)
        doc = np.repeat(np.arange(len(offsets) - 1), words.counts())
        edges = grams_long(words.hash, window)
        starts = np.flatnonzero(doc[: len(edges)] == doc[window - 1 :]) if len(edges) else np.zeros(0, np.int64)
        yield first, offsets, words, starts, edges[starts]


class Graph:
    """Repeated edges of a corpus, its junctions and its verified paths, as arrays in the shared folder."""

    def __init__(self, docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> None:
        self.folder, self.ranges, self.window = shared_folder(docs.sparkSession), ranges_for(docs, text_col), window
        texts = docs.select(F.col(text_col).cast("string"))
        repeated(texts.mapInArrow(self._pack(lambda c: (e for *_, e in text_edges(c, window))), PACKED), self.folder)
        self._write_junctions(texts)
        repeated(texts.mapInArrow(self._pack(lambda c: (p[5] for p in self.paths(c))), PACKED), self.folder, "path")

    def _pack(self, hashes_of):
        ranges = self.ranges

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from pack_hashes(batches, lambda b: hashes_of(b.column(0)), ranges)

        return run

    def steps(self, column: pa.Array) -> Iterator[tuple]:
        """(first row, offsets, words, start, edge, whether it follows the one before) of the repeated edges."""
        for first, offsets, words, starts, edges in text_edges(column, self.window):
            hit = contains(self.folder, "repeated", self.ranges, edges)
            starts, edges = starts[hit], edges[hit]
            doc = np.searchsorted(words.bounds, starts, "right") - 1
            follows = np.zeros(len(starts), bool)
            follows[1:] = (starts[1:] == starts[:-1] + 1) & (doc[1:] == doc[:-1])
            yield first, offsets, words, starts, edges, follows

    def _write_junctions(self, texts: DataFrame) -> None:
        """Edges whose neighbour before (JOINS) or after (PARTS) differs among their occurrences."""
        folder, ranges = self.folder, self.ranges

        def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def send() -> pa.RecordBatch:
                rows = np.concatenate(held) if held else np.zeros((0, 3), np.uint64)
                _, once = np.unique(mix(rows[:, 0] + mix(rows[:, 1] + mix(rows[:, 2]))), return_index=True)
                rows = rows[once]
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                at = cuts(rows[:, 0], ranges)
                full = [i for i in range(ranges) if at[i + 1] > at[i]]
                return pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([rows[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())],
                    names=["range", "packed"])

            for batch in batches:
                for *_, edges, follows in self.steps(batch.column(0)):
                    rows = np.zeros((len(edges), 3), np.uint64)
                    rows[:, 0] = edges
                    rows[1:, 1] = np.where(follows[1:], edges[:-1], np.uint64(0))
                    rows[:-1, 2] = np.where(follows[1:], edges[1:], np.uint64(0))
                    held.append(rows)
                    if sum(map(len, held)) >= RANGE_ENTRIES // 2:
                        yield send()
                        held.clear()
            yield send()

        def reduce(key: tuple, table: pa.Table) -> pa.Table:
            rows = np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, 3) for x in table["packed"].to_pylist()])
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            heads = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            kind = np.zeros(len(heads), np.uint8)
            for side, code in ((1, JOINS), (2, PARTS)):
                differ = np.maximum.reduceat(rows[:, side], heads) != np.minimum.reduceat(rows[:, side], heads)
                kind += differ.astype(np.uint8) * np.uint8(code)
            cut = kind > 0
            write_array(folder, f"junction-{key[0].as_py()}", rows[heads[cut], 0])
            write_array(folder, f"kind-{key[0].as_py()}", kind[cut])
            return pa.table({"n": pa.array([int(cut.sum())], pa.int64())})

        packed = texts.mapInArrow(sides, PACKED)
        packed.groupBy("range").applyInArrow(reduce, "n bigint").agg(F.sum("n")).first()

    def paths(self, column: pa.Array) -> Iterator[tuple]:
        """(first row, offsets, words, start of each path, its number of edges, its hash)."""
        for first, offsets, words, starts, edges, follows in self.steps(column):
            kind = np.zeros(len(edges), np.uint8)
            for i, where, slot in find(self.folder, "junction", self.ranges, edges):
                kind[where] = read_array(self.folder, f"kind-{i}")[slot]
            begins = ~follows | ((kind & JOINS) > 0)
            begins[1:] |= (kind[:-1] & PARTS) > 0
            heads = np.flatnonzero(begins)
            lengths = np.diff(np.append(heads, len(edges)))
            if not len(heads):
                yield first, offsets, words, heads, lengths, np.zeros(0, np.uint64)
                continue
            content = np.add.reduceat(edges, heads)
            ends = np.stack([edges[heads], content, edges[heads + lengths - 1], lengths.astype(np.uint64)], axis=1)
            yield first, offsets, words, starts[heads], lengths, grams(ends.ravel(), 4)[::4]


def covered_words(n_words: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which words lie in one of the spans."""
    steps = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + lengths, minlength=n_words + 1)
    return np.cumsum(steps[:n_words]) > 0


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by one space)."""
    graph = Graph(docs, text_col, window)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            for _, offsets, words, starts, lengths, path in graph.paths(batch.column(1)):
                known = contains(graph.folder, "path", graph.ranges, path)
                gone = covered_words(len(words.hash), starts[known], lengths[known] + window - 1)
                raw, bounds = words.data.tobytes(), words.bounds.tolist()
                for i in range(len(offsets) - 1):
                    a, b = bounds[i], bounds[i + 1]
                    lost = gone[a:b]
                    own = raw[offsets[i] : offsets[i + 1]].split()
                    text = b" ".join(compress(own, (~lost).tolist()) if lost.any() else own)
                    counts.append(b - a)
                    removed.append(int(lost.sum()))
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        strip, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Paths with their places: path, id, start, n_words, copies, source (smallest id and start)."""
    graph = Graph(docs, text_col, window)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words, starts, lengths, path in graph.paths(batch.column(1)):
                doc = np.searchsorted(words.bounds, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), batch.column(0).take(pa.array(first + doc)),
                     pa.array((starts - words.bounds[doc]).astype(np.int64)), pa.array((lengths + window - 1).astype(np.int64))],
                    names=["path", id_col, "start", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = checkpointed(docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        places, f"path bigint, `{id_col}` {kind}, start bigint, n_words bigint"))
    sources = found.groupBy("path").agg(
        F.count("*").alias("copies"), F.min(F.struct(id_col, "start")).alias("source"), F.min("n_words").alias("_n"))
    return found.join(sources, "path").where("n_words = _n and copies > 1").drop("_n")
