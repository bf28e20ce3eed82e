"""Words and their hashes for whole Arrow batches of texts, without a Python loop over words.

A word is a run of bytes outside space and 0x09-0x0D; UTF-8 has none of these inside a
character.  A null text counts as an empty one.  Hashes do not depend on the worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            powers = np.full(size, np.uint64(base))
            powers[0] = 1
            _powers[name] = np.multiply.accumulate(powers)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; a run exceeds the limit only if one text does."""
    data, offsets = utf8(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words of a run of texts: `begin`, `end` (bytes), `hash`, and `bounds` (first word of each text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        self.data = LOWER[data] if lower else data
        n = len(data)
        inside = ~SPACE[data]
        starts = offsets[:-1][offsets[:-1] < n]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[starts] = inside[starts]
        before = starts[starts > 0] - 1
        closes[before] = inside[before]
        self.inside = inside
        self.begin, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.begin]) * down[self.begin])
        self.bounds = np.searchsorted(self.begin, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def word_hash(word: str) -> int:
    """The hash that Words gives this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= _ROLL
        out += hashes[i : i + size]
    return mix(out)


def grams_long(hashes: np.ndarray, n: int) -> np.ndarray:
    """As grams(), at a cost that does not depend on n: for one long run of words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    up, down = _tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:size])
