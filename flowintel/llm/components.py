"""Connected components by alternating star operations, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.session import checkpointed, compacted, tasks_for


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node with a link.

    Large star: every node hands its larger neighbours to its smallest one.  Small star: the
    same for its smaller neighbours and itself.  Both keep the components; when nothing
    changes any more, every node points to its root.  Each round is written to the shared
    folder.  Groups are only reduced to their minimum, so a large star is no hot task.  The number
    of edges never grows, so the first one bounds the tasks of all rounds.
    """
    edges = compacted(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = _state(edges)
    tasks = tasks_for(last[0])
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            lower.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        edges = checkpointed(small.coalesce(tasks))
        state = _state(edges)
        if state == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct().coalesce(tasks)
        last = state


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
