"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans.lineage import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 64) -> DataFrame:
    """(node, root) with root the smallest node that is reachable.

    Minimum labels move over the edges and then jump along the pointers that
    they form, so a path of n nodes takes about log n rounds. Each round is two
    equi-joins and one partially aggregated minimum; hot nodes are left to the
    skew handling of the join. Self loops give single nodes; edges with a null
    end are ignored; an empty table gives no rows. Raises when `limit` rounds
    were not enough, which needs a path of over 2**(limit/2) nodes.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = cut(known.union(known.select("b", "a")).distinct(), "edges")
    whole = labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "cc")
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = cut(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")), "cc")
        discard(whole)
        whole, labels = new, new.select("node", "root")
        if not new.where("moved").limit(1).count():
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {limit} rounds")


def merged(labels: DataFrame, new: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """labels (node, root) once new edges have come: clusters that an edge joins have the smaller root.

    Only the roots of the edges' ends go through rounds; clusters without a new edge
    keep their rows as they are. Nodes that had no edge are clusters of one before.
    """
    ends = new.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    rooted = ends.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    rooted = cut(rooted.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"), F.col("ra").isNull().alias("new_a"), F.col("rb").isNull().alias("new_b")), "ends")
    moves = connected_components(rooted.where("ra <> rb"), "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("to"))
    nodes = rooted.where("new_a").select(F.col("a").alias("node")).union(rooted.where("new_b").select("b")).distinct()
    every = labels.select("node", "root").union(nodes.select("node", F.col("node").alias("root")))
    return cut(every.join(moves, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "cc")


def parted(labels: DataFrame, edges: DataFrame, gone: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """labels (node, root) once some edges are gone; edges: what is left of all of them.

    Only clusters that lost an edge are worked out again, from their own edges; nodes
    without an edge are in no cluster.
    """
    ends = gone.select(F.col(a).alias("node")).union(gone.select(F.col(b))).where("node is not null").distinct()
    touched = cut(labels.join(ends, "node", "left_semi").select("root").distinct(), "touched")
    members = labels.join(touched, "root", "left_semi").select(F.col("node").alias("a"))
    inside = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).join(members, "a", "left_semi")
    again = connected_components(inside)
    return cut(labels.select("node", "root").join(touched, "root", "left_anti").select("node", "root").union(again.select("node", "root")), "cc")
