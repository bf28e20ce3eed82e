"""Sorted hash arrays in the shared folder, which the workers map into memory.

Hashes of a whole corpus are too many to travel as rows.  Each task packs its own ones,
made unique, into one binary per hash range; a range is reduced by one task, and its
sorted result becomes a file in the folder of `spark.checkpoint.dir`.  The number of
ranges follows the size of the corpus, so that a range has a bounded size; a frequent
hash arrives once or twice from each task, so it is no hot key.  Files are written under a
new name and then renamed: a repeated task replaces a file by an equal one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowintel.session import ensure_checkpoint_dir

RANGE_ENTRIES = 2_000_000
BYTES_PER_WORD = 5
PACKED = "range int, packed binary"


def shared_folder(spark: SparkSession) -> str:
    """A new folder, as a path that driver and executors can open; remote stores must be mounted."""
    root = ensure_checkpoint_dir(spark)
    scheme, _, path = root.rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError("memory-mapped arrays need spark.checkpoint.dir in a mounted shared folder (file:)")
    folder = os.path.join("/" + path.lstrip("/"), f"arrays-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def ranges_for(docs: DataFrame, text_col: str = "text", per_word: float = 1.0) -> int:
    """Number of hash ranges that keeps each near RANGE_ENTRIES, from the size of all texts."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return int(size / BYTES_PER_WORD * per_word / RANGE_ENTRIES) + 1


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash; in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Position where each range begins in sorted hashes, and the end."""
    return np.searchsorted(range_of(sorted_hashes, ranges), np.arange(ranges + 1))


def at_most_twice(hashes: np.ndarray) -> np.ndarray:
    """Sorted hashes; of equal ones two stay."""
    hashes = np.sort(hashes)
    keep = np.ones(len(hashes), bool)
    keep[2:] = hashes[2:] != hashes[:-2]
    return hashes[keep]


def pack_hashes(
    batches: Iterator[pa.RecordBatch], hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], ranges: int,
    limit: int = RANGE_ENTRIES,
) -> Iterator[pa.RecordBatch]:
    """One binary per range with this task's hashes; a full buffer is sent before the end."""
    held: list[np.ndarray] = []
    size = 0

    def send() -> pa.RecordBatch:
        hashes = at_most_twice(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        at = cuts(hashes, ranges)
        full = [i for i in range(ranges) if at[i + 1] > at[i]]
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in full], pa.binary())],
            names=["range", "packed"])

    for batch in batches:
        for hashes in hashes_of(batch):
            held.append(hashes)
            size += len(hashes)
            if size >= limit:
                yield send()
                held.clear()
                size = 0
    yield send()


def repeated(packed: DataFrame, folder: str, prefix: str = "repeated") -> int:
    """Write the hashes that occur at least twice, one sorted file per range; returns their number."""
    def reduce(key: tuple, table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["packed"].to_pylist()]
        hashes = np.sort(np.concatenate(parts))
        twice = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        write_array(folder, f"{prefix}-{key[0].as_py()}", twice)
        return pa.table({"n": pa.array([len(twice)], pa.int64())})

    return packed.groupBy("range").applyInArrow(reduce, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    draft = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(draft, "wb") as out:
        np.save(out, values)
    os.replace(draft, os.path.join(folder, f"{name}.npy"))


_open: dict[tuple[str, str], np.ndarray | None] = {}


def read_array(folder: str, name: str) -> np.ndarray | None:
    """The array, mapped and kept open by this worker; None if its range was empty."""
    if (folder, name) not in _open:
        if any(f != folder for f, _ in _open):
            _open.clear()
        path = os.path.join(folder, f"{name}.npy")
        found = np.load(path, mmap_mode="r") if os.path.exists(path) and os.path.getsize(path) else None
        _open[folder, name] = found if found is not None and len(found) else None
    return _open[folder, name]


def find(folder: str, prefix: str, ranges: int, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, positions among `hashes`, positions in the range's array) of all hashes that the arrays hold."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    at = cuts(ordered, ranges)
    for i in range(ranges):
        keys = read_array(folder, f"{prefix}-{i}") if at[i + 1] > at[i] else None
        if keys is None:
            continue
        wanted = ordered[at[i] : at[i + 1]]
        slot = np.searchsorted(keys, wanted)
        slot[slot == len(keys)] = 0
        hit = keys[slot] == wanted
        yield i, order[at[i] : at[i + 1]][hit], slot[hit]


def contains(folder: str, prefix: str, ranges: int, hashes: np.ndarray) -> np.ndarray:
    found = np.zeros(len(hashes), bool)
    for _, where, _ in find(folder, prefix, ranges, hashes):
        found[where] = True
    return found
