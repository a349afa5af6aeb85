"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlatlas.llm.common import stage


def _to_smallest(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links every ``v`` of ``pairs (u, v)`` to the smallest of ``u`` and its partners in ``edges (u, v)``.

    The smallest partner is a ``min`` with map-side combine; a hub with
    millions of partners meets it in a join whose other side has one row.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; ``root`` is the smallest reachable node.

    Each round links larger neighbours to the smallest neighbour, then each
    node and its smaller neighbours to the smallest of them, until every edge
    points at a root; rounds grow with the logarithm of the longest path.
    Every round is written to ``folder`` (shared storage), so a lost executor
    costs one round. Self-loops and repeated edges are allowed; null ends are
    dropped; an empty edge table gives an empty result.
    """
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                folder, "edges-0")
    k = 0
    while True:
        k += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_to_smallest(both, both.where("v > u")).where("u <> v").distinct(), folder, f"edges-{k}-large")
        # here u > v: link u and its smaller partners to the smallest of them
        small = _to_smallest(large, large).where("u <> v")
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        now = stage(small.union(own).distinct(), folder, f"edges-{k}")
        # done when every child has one parent, which is no child itself
        open_ends = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(
            now.select(F.col("v").alias("u")).join(now, "u", "left_semi"))
        if open_ends.isEmpty():
            break
    children = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return children.union(children.select(F.col("root").alias("node"), "root").distinct())
