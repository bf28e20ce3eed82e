"""SimHash near duplicates by a self-join of the binary trie of all fingerprints.

Fingerprint.  Texts are lower-cased (A-Z only) and cut into words; every run of SHINGLE words,
repeats included, joined by one space, is hashed by XXH64 with seed 42.  A bit of the 64-bit
fingerprint is 1 if it is set in over half of the hashes.  A text with fewer words is one
shingle; null and wordless texts have the fingerprint zero and link like any other.  Texts are
read in blocks, so a long one needs no more memory than its words in one block.

Trie.  Documents with one fingerprint are one leaf, so copies cost nothing.  The trie is cut
into subtries of at most `leaf` distinct fingerprints: a node that holds more is split by STEP
further bits, and only its fingerprints are looked at again.  Since fingerprints are distinct,
every node is small enough at some depth: no group is unbounded, whatever the texts share.

Join.  Node pairs are traversed together from the pair (root, root).  A pair carries the
number of bits in which its two prefixes differ; as soon as this exceeds the budget the pair
is pruned.  The upper levels are joins of the small table of nodes; each surviving pair of
subtries is then traversed to the fingerprints within one row of a map over batches, level by
level in arrays, at most FRONTIER pairs at a time.  A subtrie at depth d meets at most
1 + d + d(d-1)/2 others (budget 2), so this is also the factor by which fingerprints, eight
bytes each, are copied.  Texts never leave the first scan.

Links.  A fingerprint has at most 2,080 others within two bits.  `links` returns all of them;
`near_duplicates` reduces the links of each pair of subtries to a forest and a count per
fingerprint where they are found, and joins the forests by components().

Ids may be null or repeated: component_id is the smallest id that is not null, and null if there
is none.  Columns other than id and text are not read, so their names cannot clash.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.llm.components import components
from flowintel.session import checkpointed, join_per_key

SHINGLE = 3
SEED = 42
BITS = 64
BUDGET = 2
LEAF = 65_536
STEP = 4
FRONTIER = 1 << 14
COMPARED = 64
TEXT_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_blocks(text: bytes, size: int = SHINGLE, block: int = TEXT_BLOCK) -> Iterator[list[bytes]]:
    """All runs of `size` words of a text, in lists that each come from about one block of it."""
    kept: list[bytes] = []
    at, whole = 0, True
    while at < len(text):
        cut = _SPACE.search(text, at + block)
        end = cut.start() if cut else len(text)
        words = kept + text[at:end].lower().split()  # bytes: lowers A-Z and splits at 0x20 and 0x09-0x0D only
        at = end
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            yield [joined[b:e] for b, e in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
            whole = False
        kept = words[-(size - 1) :] if size > 1 else []
    if whole and kept:
        yield [b" ".join(kept)]


def fingerprint(text: bytes | None, size: int = SHINGLE, block: int = TEXT_BLOCK) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    counts, total = np.zeros(BITS, np.int64), 0
    for shingles in shingle_blocks(text or b"", size, block):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], ">u8")
        for i in range(0, len(hashes), 1 << 16):
            counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        total += len(shingles)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.array([fingerprint(t.as_py(), size) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, fp bigint")


def _children(sorted_prints: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the second child begins in each node [low, high) of a depth."""
    bit = np.uint64(1 << (BITS - 1 - depth))
    prefix = sorted_prints[low] & ~np.uint64((1 << (BITS - depth)) - 1)
    return np.clip(np.searchsorted(sorted_prints, prefix | bit), low, high)


def trie_join(
    a: np.ndarray, b: np.ndarray, depth_a: int, depth_b: int, spent: int, same: bool, budget: int = BUDGET,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of all pairs within the budget, of two subtries given as sorted fingerprints.

    `spent` bits differ between the prefixes; with `same`, a and b are one subtrie and each pair comes once.
    """
    if not (len(a) and len(b)):
        return
    start = min(depth_a, depth_b)
    whole = (np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([spent]))
    stack = [(start, whole)]
    while stack:
        depth, (al, ah, bl, bh, err) = stack.pop()
        few = ((ah - al) * (bh - bl) <= COMPARED) | (depth == BITS)
        if few.any():
            width = (bh - bl)[few]
            size = (ah - al)[few] * width
            node = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size)
            i, j = al[few][node] + place // width[node], bl[few][node] + place % width[node]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        rest = ~few
        if not rest.any():
            continue
        al, ah, bl, bh, err = (x[rest] for x in (al, ah, bl, bh, err))
        am = _children(a, al, ah, depth) if depth >= depth_a else None
        bm = _children(b, bl, bh, depth) if depth >= depth_b else None
        own = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        parts = []
        for x in (0, 1) if am is not None else (None,):
            for y in (0, 1) if bm is not None else (None,):
                p = (al, ah) if x is None else ((al, am) if x == 0 else (am, ah))
                q = (bl, bh) if y is None else ((bl, bm) if y == 0 else (bm, bh))
                now = err + int(x is not None and y is not None and x != y)
                keep = (now <= budget) & (p[0] < p[1]) & (q[0] < q[1])
                if x == 1 and y == 0:
                    keep &= ~own
                parts.append([v[keep] for v in (*p, *q, now)])
        pairs = [np.concatenate(v) for v in zip(*parts)]
        stack += [(depth + 1, tuple(v[k : k + FRONTIER] for v in pairs)) for k in range(0, len(pairs[0]), FRONTIER)]


def _prefix(depth: int) -> str:
    return f"shiftrightunsigned(fp, {BITS - depth})" if depth else "0L"


def subtries(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(depth, prefix, packed): the leaves of the upper trie with their sorted fingerprints, at most `leaf` each."""
    depth = int(log2(max(prints.count() / leaf, 1))) // STEP * STEP
    placed = None
    while True:
        at = prints.selectExpr("fp", f"{_prefix(depth)} AS prefix", f"{depth} AS depth")
        large = checkpointed(at.groupBy("prefix").count().where(F.col("count") > leaf).select("prefix", F.lit(True).alias("_large")))
        done = large.isEmpty()
        at = at if done else join_per_key(at, large, "prefix")
        ready = (at if done else at.where("_large IS NULL")).select("depth", "prefix", "fp")
        placed = ready if placed is None else placed.unionByName(ready)
        if done:
            break
        prints, depth = at.where("_large").select("fp"), depth + STEP

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        held = np.sort(table["fp"].to_numpy().view(np.uint64))
        return pa.table({"depth": pa.array([key[0].as_py()], pa.int32()), "prefix": pa.array([key[1].as_py()], pa.int64()),
                         "packed": pa.array([held.tobytes()], pa.binary())})

    return checkpointed(placed.groupBy("depth", "prefix").applyInArrow(pack, "depth int, prefix bigint, packed binary"))


def subtrie_pairs(leaves: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(p_depth, p, q_depth, q, spent): all pairs of upper leaves whose prefixes differ in at most `budget` bits."""
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    pairs = leaves.sparkSession.createDataFrame([(0, 0, 0, 0, 0)], "p_depth int, p bigint, q_depth int, q bigint, spent int")
    for depth in range(0, deepest, STEP):
        nodes = leaves.where(f"depth > {depth}").selectExpr(
            f"{depth} AS up_depth", f"shiftrightunsigned(prefix, depth - {depth}) AS up",
            f"shiftrightunsigned(prefix, depth - {depth + STEP}) AS child").distinct()
        for side in "pq":
            pairs = pairs.join(nodes, (F.col(f"{side}_depth") == F.col("up_depth")) & (F.col(side) == F.col("up")), "left")
            pairs = pairs.withColumn(f"{side}_child", F.col("child")).drop("up_depth", "up", "child")
        both = "p_child IS NOT NULL AND q_child IS NOT NULL"
        pairs = pairs.where(f"NOT ({both} AND p = q AND p_depth = q_depth AND p_child > q_child)").selectExpr(
            f"IF(p_child IS NULL, p_depth, {depth + STEP}) AS p_depth", "coalesce(p_child, p) AS p",
            f"IF(q_child IS NULL, q_depth, {depth + STEP}) AS q_depth", "coalesce(q_child, q) AS q",
            f"spent + IF({both}, bit_count((p_child ^ q_child) & {(1 << STEP) - 1}), 0) AS spent").where(f"spent <= {budget}")
        pairs = checkpointed(pairs)
    return pairs


def _map_pairs(prints: DataFrame, reduce: Callable, schema: str, budget: int, leaf: int) -> DataFrame:
    """`reduce` on the sorted fingerprints and the found positions of every pair of subtries."""
    leaves = subtries(prints, leaf)
    pairs = subtrie_pairs(leaves, budget)
    for side in "pq":
        held = leaves.select(F.col("depth").alias(f"{side}_depth"), F.col("prefix").alias(side), F.col("packed").alias(f"{side}_packed"))
        pairs = pairs.join(held, [f"{side}_depth", side])
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.selectExpr("p_depth", "q_depth", "spent", "p = q AND p_depth = q_depth AS same", "p_packed", "q_packed", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p_depth, q_depth, spent, same, p, q = (batch.column(c)[row].as_py() for c in range(6))
                a = np.frombuffer(p, np.uint64)
                b = a if same else np.frombuffer(q, np.uint64)
                yield from reduce(a, b, same, trie_join(a, b, p_depth, q_depth, spent, same, budget))

    return rows.repartition(tasks, "p", "q").mapInArrow(run, schema)


def links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(a, b, distance) of all pairs of distinct fingerprints (column fp) within the budget, each once."""
    def pairs(a, b, same, found):
        for i, j in found:
            low, high = a[i].view(np.int64), b[j].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(low, high)), pa.array(np.maximum(low, high)),
                 pa.array(np.bitwise_count(a[i] ^ b[j]).astype(np.int32))], names=["a", "b", "distance"])

    return _map_pairs(prints, pairs, "a bigint, b bigint, distance int", budget, leaf)


def hooked(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (each node's own position at first) after joining the trees of i and j."""
    while True:
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
        ri, rj = root[i], root[j]
        apart = ri != rj
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
        i, j = i[apart], j[apart]


def forests(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF) -> DataFrame:
    """(fp, root, n): links of each pair of subtries as a forest, with the number of links of each fingerprint in it."""
    def forest(a, b, same, found):
        nodes = a if same else np.concatenate([a, b])
        root, count = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for i, j in found:
            j = j if same else j + len(a)
            count += np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            root = hooked(root, i, j)
        some = np.flatnonzero(count)
        nodes = nodes.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(count[some])], names=["fp", "root", "n"])

    return _map_pairs(prints, forest, "fp bigint, root bigint, n bigint", budget, leaf)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, leaf: int = LEAF,
) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id, n_copies (rows with the same fingerprint,
    itself included) and n_near (other fingerprints within the budget)."""
    rows = checkpointed(with_fingerprint(docs, id_col, text_col))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n_copies")))
    trees = checkpointed(forests(prints.select("fp"), budget, leaf))
    near = trees.groupBy("fp").agg(F.sum("n").alias("n_near"))
    roots = components(trees.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    members = prints.join(roots, F.col("fp") == F.col("node"))
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(ids, "root").select("fp", "component_id").join(near, "fp")
    classes = prints.join(linked, "fp", "left").selectExpr(
        "fp", "n_copies", "IF(n_near IS NULL, least, component_id) AS component_id", "coalesce(n_near, 0L) AS n_near")
    return rows.join(classes, "fp").selectExpr(
        "id AS doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id", "n_copies", "n_near")
