"""Hard-negative mining with exact integer scores from a residue-number-system matrix product.

Scores.  Components are integers.  Every one is reduced modulo a few small primes to a residue
around zero; for each prime the residue matrices of a block of anchors and a block of rows are
multiplied in float32.  A prime p is so small that DEPTH products of residues stay below 2**24, where
float32 is exact; longer vectors are multiplied in pieces whose products are reduced before they are
added.  The signed score follows from its residues by Chinese remaindering in balanced mixed
radix.  The number of primes follows from the greatest squared norm of the table, which
bounds every score (Cauchy-Schwarz), so no score is rounded or wraps.

Blocks.  Rows are packed where they are scanned, ROW_BLOCK to a binary, and dealt to groups of
at most about GROUP_ROWS rows; anchors are dealt by hash to blocks of about ANCHOR_BLOCK, and SHARE
blocks make a share.  A task joins one group with one share: each anchor is sent to every group,
each row to every share.  The task meets the row blocks of one anchor block in a row and keeps
only the best so far per anchor, so it emits a few rows per anchor and group, however many rows
a label or a repeated vector has.

Windowed selection.  A first pass finds each anchor's best rows of its own label (positives).  A second
pass finds, per anchor and positive, the best rows of other labels whose score lies in the window
low * positive <= 100 * score <= high * positive.  Candidates of all groups meet in a window per anchor.

Higher scores come first, equal ones by smaller id.  A row without id, label or vector, or with a
null or non-finite component, takes no part.  Vectors of different lengths are compared as if the shorter
ones ended in zeros.  An anchor never meets rows with its own id; rows that repeat
an id are otherwise rows like others.  A squared norm above NORM_LIMIT raises an error, because
the window test could leave the range of a long.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowintel.session import checkpointed

DEPTH = 256
EXACT = 1 << 24
NORM_LIMIT = (1 << 63) // 128
ROW_BLOCK = 8_192
ANCHOR_BLOCK = 1_024
GROUP_ROWS = 1 << 20
SHARE = 256
TILE = 256
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
LEAST = np.iinfo(np.int64).min
_PACKED = "ids binary, labels binary, vectors binary, norm bigint, width int, n int"


def primes_for(width: int, bound: int) -> list[int]:
    """The largest primes whose residue products are exact in float32, enough of them for scores in [-bound, bound]."""
    top = 2 * isqrt((EXACT - 1) // min(max(width, 1), DEPTH)) + 1
    found, product = [], 1
    while product <= 2 * bound + 1:
        while any(top % f == 0 for f in range(2, isqrt(top) + 1)):
            top -= 1
        found.append(top)
        product *= top
        top -= 1
    return found


def residues(matrix: np.ndarray, p: int) -> np.ndarray:
    """Residues of integers modulo p in [-(p - 1) / 2, (p - 1) / 2], as float32."""
    r = np.mod(matrix, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, around zero, from float32 products of at most DEPTH terms."""
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], DEPTH):
        total += np.rint(a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T).astype(np.int64)
    return centred(total, p)


def centred(values: np.ndarray, p: int) -> np.ndarray:
    values = np.mod(values, p)
    return np.where(values > p // 2, values - p, values)


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Signed integers from their residues: balanced mixed-radix digits, least significant first."""
    total, scale = np.zeros_like(parts[0]), 1
    for part, p in zip(parts, primes):
        digit = centred(centred(part - np.mod(total, p), p) * pow(scale, -1, p), p)
        total = total + digit * scale
        scale *= p
    return total


class Block:
    """Rows of one binary in order of id, with their residues for the given primes."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, n: int, width: int, primes: list[int]) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        matrix = np.frombuffer(vectors, np.int32).reshape(n, -1)
        self.residues = [residues(np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))), p) for p in primes]


def scores(anchors: Block, rows: Block, begin: int, end: int, primes: list[int]) -> np.ndarray:
    """Exact inner products of the anchors from begin to end with all rows."""
    return remaindered([residue_product(a[begin:end], b, p) for a, b, p in zip(anchors.residues, rows.residues, primes)], primes)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k greatest allowed scores of each line; of equal scores the first columns."""
    n = score.shape[1]
    if n > k and abs(score).max(initial=0) < (1 << 62) // n:
        key = np.where(allowed, score * n + np.arange(n - 1, -1, -1), LEAST)
        columns = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        key = np.where(allowed, score, LEAST)
        columns = np.argsort(-np.maximum(key, LEAST + 1), axis=1, kind="stable")[:, :k]
    line = np.repeat(np.arange(len(score)), columns.shape[1])
    column = columns.ravel()
    kept = allowed[line, column]
    return line[kept], column[kept]


def packed_rows(rows: DataFrame, block: int = ROW_BLOCK) -> DataFrame:
    """Blocks of usable rows (id, label, vector: array of double with integer values), in order of id, packed where they are."""
    def pack(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        width = max(m.shape[1] for *_, m in held)
        ids, labels = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        matrix = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for *_, m in held])
        order = np.argsort(ids, kind="stable")
        norm = int((matrix.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (1 + 1e-9)) + 1
        if norm > NORM_LIMIT:
            raise ValueError(f"a squared norm exceeds {NORM_LIMIT}")
        return pa.RecordBatch.from_arrays(
            [*[pa.array([x[order].tobytes()], pa.binary()) for x in (ids, labels, matrix)],
             pa.array([norm], pa.int64()), pa.array([width], pa.int32()), pa.array([len(ids)], pa.int32())],
            names=["ids", "labels", "vectors", "norm", "width", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                lists = batch.column(2)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                width = int(lengths.max(initial=0))
                matrix = np.zeros((len(lengths), width))
                matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                if abs(matrix).max(initial=0) > isqrt(NORM_LIMIT):
                    raise ValueError(f"a squared norm exceeds {NORM_LIMIT}")
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix.astype(np.int32)))
                size += len(lengths)
                if size >= block:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return rows.mapInArrow(run, _PACKED)


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """id, label and vector (array of double) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), vector.alias("vector"))


def _merged(pairs: DataFrame, width: int, primes: list[int], per_positive: bool, k: int, window: tuple[int, int]) -> DataFrame:
    """Best rows per anchor (and positive) over each run of row blocks: block, anchor, positive, id, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, anchors, found = None, None, []

        def reduced(parts: list[np.ndarray]) -> np.ndarray:
            """The k best of (anchor, positive, id, score) per anchor and positive."""
            lines = np.concatenate(parts)
            lines = lines[np.lexsort((lines[:, 2], -lines[:, 3], lines[:, 1], lines[:, 0]))]
            group = np.concatenate([[True], (lines[1:, :2] != lines[:-1, :2]).any(axis=1)])
            first = np.maximum.accumulate(np.where(group, np.arange(len(lines)), 0))
            return lines[np.arange(len(lines)) - first < k]

        def send(name: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if parts:
                lines = reduced(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lines), name)), *[pa.array(lines[:, c]) for c in range(4)]],
                    names=["block", "anchor", "positive", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(c)[row] for c, name in enumerate(batch.schema.names)}
                name = value["block"].as_py()
                if name != now:
                    yield from send(now, found)
                    now, found = name, []
                    anchors = Block(*(value[f"a_{c}"].as_py() for c in ("ids", "labels", "vectors", "n")), width, primes)
                    limits = np.frombuffer(value["limits"].as_py(), np.int64).reshape(-1, 3) if per_positive else None
                rows = Block(*(value[c].as_py() for c in ("ids", "labels", "vectors", "n")), width, primes)
                for begin in range(0, len(anchors.ids), TILE):
                    end = min(begin + TILE, len(anchors.ids))
                    score = scores(anchors, rows, begin, end, primes)
                    same = anchors.labels[begin:end, None] == rows.labels
                    other = anchors.ids[begin:end, None] != rows.ids
                    if per_positive:
                        own = limits[(limits[:, 0] >= begin) & (limits[:, 0] < end)]
                        for place in np.unique(own[:, 1]):
                            some = own[own[:, 1] == place]
                            at, bar = some[:, 0] - begin, some[:, 2:]
                            part = score[at]
                            fit = other[at] & ~same[at] & (window[0] * bar <= 100 * part) & (100 * part <= window[1] * bar)
                            line, column = best(part, fit, k)
                            found.append(np.stack([some[line, 0], np.full(len(line), place), rows.ids[column], part[line, column]], axis=1))
                    else:
                        line, column = best(score, other & same, k)
                        found.append(np.stack([line + begin, np.zeros(len(line), np.int64), rows.ids[column], score[line, column]], axis=1))
                if sum(map(len, found)) > 8 * k * max(len(anchors.ids), 1):
                    found = [reduced(found)]
        yield from send(now, found)

    return pairs.mapInArrow(run, "block bigint, anchor bigint, positive bigint, id bigint, score bigint")


def mined(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, group_rows: int = GROUP_ROWS,
    share: int = SHARE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `rows` and `anchors` have id, label and vector as usable() makes them, with integer values.
    """
    blocks = checkpointed(packed_rows(rows, row_block).withColumn("_at", F.monotonically_increasing_id()))
    sums = blocks.agg(F.max("norm").alias("norm"), F.max("width").alias("width"), F.sum("n").alias("n")).first()
    width, n = sums["width"] or 0, sums["n"] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n // group_rows), min(tasks, -(-n // row_block)), 1)
    primes = primes_for(width, sums["norm"] or 0)
    anchor_blocks = -(-anchors.count() // anchor_block) or 1
    shares = -(-anchor_blocks // share)
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    dealt = blocks.select(F.pmod(F.xxhash64("_at"), F.lit(groups)).alias("group"), every.alias("share"), "ids", "labels", "vectors", "n")
    spread = anchors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(anchor_blocks)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table["vector"].combine_chunks() if isinstance(table["vector"], pa.ChunkedArray) else table["vector"]
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(lengths), width), np.int32)
        matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        return pa.table({"block": table["block"].slice(0, 1), **{
            name: pa.array([x.tobytes()], pa.binary()) for name, x in (("a_ids", ids), ("a_labels", labels), ("a_vectors", matrix))},
            "a_n": pa.array([len(ids)], pa.int32())})

    packed = checkpointed(spread.groupBy("block").applyInArrow(
        pack, "block bigint, a_ids binary, a_labels binary, a_vectors binary, a_n int"))

    def met(side: DataFrame) -> DataFrame:
        """Every anchor block beside every row block of every group; anchors are the streamed side."""
        sent = side.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("group"),
                           F.pmod("block", F.lit(shares)).cast("int").alias("share"))
        # a number of its own keeps these few heavy cells apart, which are small in bytes
        parts = [df.repartition(2 * groups * shares, "group", "share").hint("merge") for df in (sent, dealt)]
        return parts[0].join(parts[1], ["group", "share"]).drop("group", "share")

    first = _merged(met(packed), width, primes, False, positives, window)
    per_anchor = Window.partitionBy("block", "anchor").orderBy(F.desc("score"), "id")
    chosen = checkpointed(first.withColumn("place", F.row_number().over(per_anchor)).where(F.col("place") <= positives).select(
        "block", "anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def limits(table: pa.Table) -> pa.Table:
        lines = np.stack([table[c].to_numpy().astype(np.int64) for c in ("anchor", "place", "positive_score")], axis=1)
        return pa.table({"block": table["block"].slice(0, 1), "limits": pa.array([lines.tobytes()], pa.binary())})

    bars = chosen.groupBy("block").applyInArrow(limits, "block bigint, limits binary")
    second = _merged(met(packed.join(bars, "block")), width, primes, True, negatives, window)
    per_positive = Window.partitionBy("block", "anchor", "positive").orderBy(F.desc("score"), "id")
    ranked = second.withColumn("rank", F.row_number().over(per_positive)).where(F.col("rank") <= negatives)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), batch.column(0)[row].as_py())), pa.array(np.arange(len(ids))), pa.array(ids)],
                    names=["block", "anchor", "anchor_id"])

    names = packed.select("block", "a_ids").mapInArrow(named, "block bigint, anchor bigint, anchor_id bigint")
    placed = ranked.join(chosen.withColumnRenamed("place", "positive"), ["block", "anchor", "positive"])
    return placed.join(names, ["block", "anchor"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, **options) -> DataFrame:
    """Negatives of the anchors (vec_id divisible by 100) of `embeddings`, whose label moves on where vec_id is divisible by 7."""
    rows = usable(embeddings, "vec_id", "label", "embedding")
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("vector", lambda x: F.floor(x * 256).cast("double"))
    rows = rows.select("id", label.alias("label"), whole.alias("vector"))
    return mined(rows, rows.where(F.col("id") % 100 == 0), **options)
