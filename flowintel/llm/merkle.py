"""Merkle manifest of a table by time-forward processing, with membership proofs for all rows.

Tree.  A row's leaf is the SHA-256 of its fields, each written as its byte count, a colon and
its value (null: a minus sign).  Within a group (language) leaves ascend by id; runs of ARITY
neighbours become the digest of their digests until one is left, the group's subroot.  Subroots,
ordered by group, form one more tree in the same way, whose top is the root.

Forward sweep.  A node's label is (level, group, place).  Every node sends its digest to its
parent's label.  The messages are an external priority queue: a table kept in label order by
range partitions that are sorted by place, whose lowest level is drained at once, since labels
of one level do not depend on each other.  Each level is stored (checkpoint) and has an eighth
of the rows of the level below, so all levels together cost little more than the leaves.

Reversed sweep.  From the root down, every node hands its children the proof suffix: the siblings
passed on the way up.  Leaves stay inside the rows of their parents, so that the long
proofs are made where they are used and no row of proofs is shuffled per leaf.

Ranks come from a range sort by (group, id), which splits a dominant group, and from the counts
of its pieces; the number of levels is all that reaches the driver.  Texts are read once, to be
hashed, and are not shuffled.  Only built-in functions run.

Null groups come first, null ids first in their group; rows with equal ids are ordered by leaf,
and rows equal in all fields are interchangeable.  A lone leaf is its group's subroot, a lone subroot
the root.  An empty table gives no rows.  Payload columns travel in one struct, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowintel.session import checkpointed, join_per_key

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """Byte count, colon, value; a minus sign for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (grp, ...) with place (from 0) and n, the number of leaves of the group.

    After the range sort a group is a few runs of neighbouring rows; their counts give every run's first place.
    """
    keys = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    spread = leaves.withColumn("_row", F.monotonically_increasing_id())  # equal rows may still be split
    dealt = spread.repartitionByRange(*keys, "_row").sortWithinPartitions(*keys, "_row").drop("_row")
    dealt = checkpointed(dealt.withColumns({"_part": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("grp", "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("grp").alias("_grp"), F.col("_part").alias("_run"), "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_part") == F.col("_run"))
    placed = join_per_key(dealt, runs, same, "inner")
    return placed.withColumn("place", F.col("_before") + F.col("_pos") - F.col("_first")).drop(
        "_grp", "_part", "_pos", "_run", "_first", "_before")


def drained(queue: DataFrame, level: int) -> DataFrame:
    """Nodes (grp, place, n, kids, digest) of the level that receives the queue's messages (grp, place, n, kid).

    n counts the nodes of the group one level below; a group with one has reached its top, which passes through unhashed.
    """
    messages = queue.select("grp", "n", F.floor(F.col("place") / ARITY).alias("up"), F.struct("place", "kid").alias("message"))
    ordered = messages.repartitionByRange("grp", "up").sortWithinPartitions("grp", "up")
    nodes = ordered.groupBy("grp", "up").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list("message")), lambda m: m["kid"]).alias("kids"))
    joined = digest(F.array_join(F.transform("kids", lambda k: k["digest"]), ""))
    return nodes.select("grp", F.col("up").alias("place"), "n", "kids",
                        F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(joined).alias("digest"))


def forward(leaves: DataFrame) -> list[DataFrame]:
    """Stored levels of nodes above ranked leaves (grp, place, n, kid with a field digest); the last holds only tops."""
    levels = [checkpointed(drained(leaves, 1))]
    most = levels[0].agg(F.max("n").alias("n")).first()["n"] or 1
    nodes = -(-most // ARITY)
    while nodes > 1:
        fewer = F.ceil(F.col("n") / ARITY)
        queue = levels[-1].where(fewer > 1).select("grp", "place", fewer.alias("n"), F.struct("digest").alias("kid"))
        levels.append(checkpointed(drained(queue, len(levels) + 1)))
        nodes = -(-nodes // ARITY)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(grp, subroot, top_level) of every group: the node that has no parent."""
    found = None
    for k, level in enumerate(levels):
        own = level.where(F.ceil(F.col("n") / ARITY) <= 1).select("grp", F.col("digest").alias("subroot"), F.lit(k).alias("top_level"))
        found = own if found is None else found.unionByName(own)
    return found


def _delivered(nodes: DataFrame) -> DataFrame:
    """Children (grp, place, kid, proof) of nodes (grp, place, n, kids, suffix); the proof begins with the siblings."""
    kid = F.posexplode("kids").alias("slot", "kid")
    kids = nodes.select("grp", "place", "n", "suffix", "kids", kid)
    digests = F.transform("kids", lambda k: k["digest"])
    left = F.array_join(F.slice(digests, F.lit(1), F.col("slot")), "")
    right = F.array_join(F.slice(digests, F.col("slot") + 2, F.size("kids")), "")
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    proof = F.when(F.col("n") == 1, F.col("suffix")).otherwise(F.concat(step, F.col("suffix")))
    return kids.select("grp", (F.col("place") * ARITY + F.col("slot")).alias("place"), "kid", proof.alias("proof"))


def backward(levels: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """Leaves (grp, place, kid, proof), given the suffix of every group's top as seeds (grp, top_level, suffix)."""
    passed = None
    for k in range(len(levels) - 1, -1, -1):
        own = seeds.where(F.col("top_level") == k).select("grp", F.lit(0).cast("bigint").alias("place"), "suffix")
        passed = own if passed is None else passed.unionByName(own)
        node = passed.select(F.col("grp").alias("_grp"), F.col("place").alias("_place"), "suffix")
        same = F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("place") == F.col("_place"))
        kids = _delivered(levels[k].join(node, same))
        passed = kids if k == 0 else kids.select("grp", "place", F.col("proof").alias("suffix"))
    return passed


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """payload, leaf, subroot, root, proof of leaves (grp, digest, payload and the columns of `order`).

    proof is an array of (left, right) from the leaf up: the joined digests of the siblings on either side.
    """
    kept = ranked(checkpointed(leaves), [*order, "digest"])  # the range sort would hash the texts once more for its sample
    levels = forward(kept.select("grp", "place", "n", F.struct("digest", "payload").alias("kid")))
    subroots = checkpointed(tops(levels))
    upper = ranked(subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("digest"), "top_level"), ["name"])
    summit = forward(upper.select("grp", "place", "n", F.struct("digest", "name", "top_level").alias("kid")))
    root = tops(summit).select("subroot").scalar()
    none = F.array().cast("array<struct<left: string, right: string>>")
    above = backward(summit, tops(summit).select("grp", "top_level", none.alias("suffix")))
    seeds = checkpointed(above.select(
        F.col("kid.name").alias("grp"), F.col("kid.top_level").alias("top_level"), F.col("proof").alias("suffix"), F.col("kid.digest").alias("subroot")))
    rows = backward(levels, seeds.select("grp", "top_level", "suffix"))
    named = join_per_key(rows, seeds.select(F.col("grp").alias("_grp"), "subroot"), F.col("grp").eqNullSafe(F.col("_grp")), "inner")
    return named.select("kid.payload", F.col("kid.digest").alias("leaf"), "subroot", root.alias("root"), "proof")


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, tampered (leaf after a change to the text, or the leaf) of documents."""
    values = [F.col(c) for c in FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(touched & F.col("text").isNotNull(), leaf_digest([*values[:-1], lowered(F.col("text"))]))
    leaves = docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"), leaf_digest(values).alias("digest"),
        F.struct("doc_id", changed.alias("changed")).alias("payload"))
    rows = manifest(leaves, ["id"])
    return rows.select("payload.doc_id", "leaf", "subroot", "root", "proof", F.coalesce("payload.changed", "leaf").alias("tampered"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf), verified (equals root)."""
    rows = document_manifest(docs).withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
