"""Variable-capacity best-fit packing of documents into training sequences.

Permitted lengths are considered together.  Pieces go in order of falling length.  A piece
goes to the open bin with the least room that holds it.  If none does, a bin is opened at
the length that costs least per word it can expect to hold: the piece plus the words of the
pieces still to come that fit into the rest.  Last, every bin shrinks to the shortest
permitted length that holds its contents.  A text longer than the longest length is cut into
pieces of that length and a rest.

Documents are dealt to groups by a hash of id and text; the number of groups follows the
number of documents, so each group has about GROUP_DOCS documents however large the table.
Only lengths travel to the groups, not texts.

Null and empty texts have no words and no piece: one row with null piece, bin and offset.
Repeated rows are packed one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.llm.words import word_count

LENGTHS = (512, 1024, 2048, 4096)
# Cost of a bin: its length plus a share that grows with the square of it, as attention does.
SQUARE_SCALE = 8192
GROUP_DOCS = 20_000
PLACED = "doc_id bigint, piece bigint, piece_words bigint, bin string, bin_length bigint, bin_offset bigint"


def bin_cost(length: float) -> float:
    return length * (1 + length / SQUARE_SCALE)


def best_fit(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece; pieces are sorted by falling length."""
    sizes = np.array(sorted(permitted))
    # words of pieces of at most r words, for any r: rising order and its running sum
    rising = lengths[::-1]
    sums = np.concatenate([[0], np.cumsum(rising)])
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    filled: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, length in enumerate(lengths.tolist()):
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            coming = n - 1 - i
            best = None
            for size in sizes[np.searchsorted(sizes, length) :].tolist():
                fitting = min(int(np.searchsorted(rising, size - length, "right")), coming)
                content = length + min(size - length, int(sums[fitting]))
                shrunk = int(sizes[np.searchsorted(sizes, content)])
                price = bin_cost(shrunk) / content
                if best is None or price < best[0]:
                    best = (price, size)
            room, chosen = best[1], len(filled)
            filled.append(0)
        bins[i], offsets[i] = chosen, filled[chosen]
        filled[chosen] += length
        if room > length:
            insort(rooms, (room - length, chosen))
    contents = np.array(filled, np.int64)
    return bins, offsets, sizes[np.searchsorted(sizes, contents)][bins] if n else bins


def pack_group(key: tuple, rows: pd.DataFrame, permitted: tuple[int, ...] = LENGTHS) -> pd.DataFrame:
    """All pieces of one group with their bins."""
    longest = max(permitted)
    rows = rows.sort_values(["_tie", "doc_id", "size"]).reset_index(drop=True)
    pieces = np.maximum(1, -(-rows["size"].to_numpy() // longest))
    row = np.repeat(np.arange(len(rows)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(longest, rows["size"].to_numpy()[row] - number * longest)
    order = np.lexsort((np.arange(len(row)), -length))
    order = order[length[order] > 0]
    bins, offsets, sizes = best_fit(length[order], permitted)
    out = pd.DataFrame({
        "doc_id": rows["doc_id"].to_numpy()[row], "piece": pd.array(number, "Int64"), "piece_words": length})
    out["bin"] = pd.Series([None] * len(out), dtype=object)
    for name in ("bin_length", "bin_offset"):
        out[name] = pd.array([pd.NA] * len(out), "Int64")
    out.loc[order, "bin"] = [f"{key[0]}-{b}" for b in bins]
    out.loc[order, "bin_length"], out.loc[order, "bin_offset"] = sizes, offsets
    out.loc[length == 0, "piece"] = pd.NA
    return out


def pack_documents(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", permitted: tuple[int, ...] = LENGTHS,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """One row per piece: doc_id, piece, piece_words, bin, bin_length, bin_offset."""
    groups = docs.count() // group_docs + 1
    tie = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), word_count(F.col(text_col)).alias("size"), tie.alias("_tie"),
        F.pmod(tie, F.lit(groups)).alias("_group"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pack_group(key, part.astype({"doc_id": "Int64"}), permitted)

    return rows.groupBy("_group").applyInPandas(pack, PLACED)
