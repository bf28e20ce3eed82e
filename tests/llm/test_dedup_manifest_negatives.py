"""SimHash trie join, Merkle manifest and hard negatives against versions by force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, connect
from flowintel.llm import hard_negatives, merkle, simhash

SF = "/root/testdata/sf0.001"


def fingerprint_by_force(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots_by_force(prints, budget=2):
    root = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def test_fingerprints_and_classes(docs, found):
    prints = [fingerprint_by_force(t) for _, t, *_ in found]
    root = roots_by_force(prints)
    least = {r: min((i for (i, *_), q in zip(found, root) if q == r and i is not None), default=None) for r in root}
    want = sorted((str(i), f"{p:016x}", str(least[r])) for (i, *_), p, r in zip(found, prints, root))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    for r in rows:
        p = int(r.fingerprint, 16)
        assert r.n_copies == prints.count(p)
        assert r.n_near == sum(0 < (p ^ q).bit_count() <= 2 for q in set(prints))


def test_blocks_of_a_long_text():
    text = ("Ab cd\t\té fg  hi\n" * 500 + "x" * 300 + " end").encode()
    assert simhash.fingerprint(text, block=7) == simhash.fingerprint(text) == fingerprint_by_force(text.decode())
    for short in (b"", b" \n", b"one", b"Two words", b"a b c"):
        assert simhash.fingerprint(short, block=2) == fingerprint_by_force(short.decode())


def clustered(rng, n):
    """Fingerprints near a few centres, random ones, and both ends of the range."""
    centres = rng.integers(0, 1 << 64, 5, dtype=np.uint64)
    out = [0, 1, (1 << 64) - 1, (1 << 64) - 2, 1 << 63]
    for _ in range(n):
        p = int(centres[rng.integers(5)]) if rng.random() < 0.8 else int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for bit in rng.integers(0, 64, rng.integers(0, 4)):
            p ^= 1 << int(bit)
        out.append(p)
    return sorted(set(out))


@pytest.mark.parametrize("leaf", [40, 100_000])
def test_trie_links(spark, leaf):
    prints = clustered(np.random.default_rng(leaf), 300)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(3)
    got = sorted(map(tuple, simhash.links(frame, leaf=leaf).collect()))
    want = sorted((min(x, y), max(x, y), d) for i, x in enumerate(signed) for j, y in enumerate(signed[:i])
                  if (d := (prints[i] ^ prints[j]).bit_count()) <= 2)
    assert got == want and len(want) > 100
    sizes = [len(r.packed) // 8 for r in simhash.subtries(frame, leaf).collect()]
    assert sum(sizes) == len(prints) and max(sizes) <= leaf
    trees = simhash.forests(frame, leaf=leaf).groupBy("fp").agg(F.sum("n").alias("n")).collect()
    degree = {p: sum(p in (a, b) for a, b, _ in want) for p in signed}
    assert {r.fp: r.n for r in trees} == {p: n for p, n in degree.items() if n}


def test_one_group_of_near_copies_is_linear(spark):
    """A third of all fingerprints within two bits of each other: rows that leave the join stay proportional."""
    centre = 0x0123456789ABCDEF
    near = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)}
    rng = np.random.default_rng(1)
    far = {int(x) for x in rng.integers(0, 1 << 62, 2 * len(near))}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in near | far], "fp bigint")
    rows = simhash.forests(frame, leaf=4096).count()
    assert rows <= 11 * len(near) and simhash.links(frame, leaf=4096).count() > 4 * rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_by_force(digests):
    """Root, and per leaf the list of (left, right) siblings."""
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for leaf, i in enumerate(at):
            run = i // 8 * 8
            proofs[leaf].append(("".join(digests[run:i]), "".join(digests[i + 1 : run + 8])))
        digests = [sha("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
        at = [i // 8 for i in at]
    return digests[0], proofs


def manifest_by_force(rows):
    def leaf(i, text, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: tree_by_force([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = tree_by_force([built[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for x, proof in zip(sorted(groups[g], key=lambda x: x[:3]), built[g][1]):
            i, text, lang, source, n = x[3]
            path, folded = proof + above, x[2]
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                folded = leaf(i, lower, lang, source, n)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((str(i), x[2], built[g][0], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return sorted(out)


def as_rows(frame):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect())


def test_manifest(spark, docs, found):
    assert as_rows(merkle.verified_documents(docs)) == manifest_by_force(found)
    rng = np.random.default_rng(3)
    for size, langs in ((1, 1), (9, 1), (700, 29)):
        rows = [(i * 7 % 1009, f"Text {i} É", [None, *"abcdefghijklmnopqrstuvwxyzéß"][int(rng.integers(langs)) if rng.random() < 0.5 else 0],
                 "s", i) for i in range(size)]
        frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(5)
        assert as_rows(merkle.verified_documents(frame)) == manifest_by_force(rows), (size, langs)


def test_manifest_does_not_depend_on_partitions(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    want = as_rows(merkle.verified_documents(frame))
    assert as_rows(merkle.verified_documents(frame.repartition(13, "n_chars"))) == want
    assert {r[3] for r in want} == {want[0][3]} and 0 < sum(not r[6] for r in want) < len(want) / 2


def negatives_by_force(rows):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in kept:
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in kept if j != i)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(ns, j) for ns, j, other in scored if other != label and 30 * -ps <= 100 * -ns <= 90 * -ps]
            out += [(i, p, k, j, -ps, -ns) for k, (ns, j) in enumerate(fit[:10], 1)]
    return sorted(out)


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors():
    """Clusters with ties and copies, nulls, odd values, other lengths."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 20))
    rows = []
    for i in range(1200):
        v = (centres[i % 6] + rng.normal(size=20) * (0 if i % 3 == 0 else 0.6)).astype(np.float32).tolist()
        rows.append((i, v, int(rng.integers(4))))
    rows += [(5000, None, 1), (5100, [0.1] * 20, None), (5200, [], 2), (5300, [float("nan")] * 20, 1), (5400, [1.0] * 3, 1),
             (5500, [float("inf")] * 20, 1), (5600, [None] * 20, 1), (None, [0.5] * 20, 1), (-100, [2.0] * 25, 0), (-7, [0.0] * 20, 9)]
    return rows


@pytest.mark.parametrize("options", [{}, {"anchor_block": 2, "row_block": 50, "group_rows": 300, "share": 2}])
def test_negatives(spark, options):
    frame = spark.createDataFrame(vectors(), SCHEMA).selectExpr("*", "1 as id", "2 as block", "3 as rank").repartition(4)
    got = sorted(map(tuple, hard_negatives.hard_negatives(frame, **options).collect()))
    want = negatives_by_force(vectors())
    assert got == want and len(want) > 300


def test_residue_products_are_exact():
    rng = np.random.default_rng(2)
    for width, size in ((1, 1 << 28), (3, 1 << 27), (64, 300), (300, 1 << 20), (700, 5000)):
        a, b = (rng.integers(-size, size + 1, (7, width)) for _ in range(2))
        a[0], b[0] = size, -size
        want = a.astype(object) @ b.astype(object).T
        primes = hard_negatives.primes_for(width, width * size * size)
        parts = [hard_negatives.residue_product(hard_negatives.residues(a, p), hard_negatives.residues(b, p), p) for p in primes]
        if width * size * size < hard_negatives.NORM_LIMIT * 8:
            assert (hard_negatives.remaindered(parts, primes).astype(object) == want).all(), width
        assert all(min(width, hard_negatives.DEPTH) * ((p - 1) // 2) ** 2 < 1 << 24 for p in primes)


def test_best_with_ties_and_huge_scores():
    score = np.array([[5, 5, 5, 1, 5], [-3, -3, 7, 7, 7]]) * np.array([[1], [1 << 50]])
    allowed = np.array([[True, False, True, True, True], [True] * 5])
    for factor in (1, 1 << 8):
        line, column = hard_negatives.best(score * factor, allowed, 2)
        assert sorted(zip(line.tolist(), column.tolist())) == [(0, 0), (0, 2), (1, 2), (1, 3)]


def test_too_large_components_are_refused(spark):
    frame = spark.createDataFrame([(0, [3.0e30], 1), (1, [1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="squared norm"):
        hard_negatives.hard_negatives(frame).collect()


def test_empty_tables(spark, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert merkle.verified_documents(nothing).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(empty).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""
