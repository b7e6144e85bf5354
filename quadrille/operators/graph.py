"""Traversals over edge tables: closures, hops and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.plans.lineage import cut


def reachable(edges: DataFrame, seeds: list | None = None, zero: bool = False, most: int | None = None, limit: int = 10_000) -> DataFrame:
    """(a, b): b can be reached from a in one or more steps (zero: or none; most: no more than so many); from the seeds only, if given.

    Semi-naive: each round extends only the pairs that the last one found, and
    an anti join drops what is known, so cycles end.
    """
    edges = cut(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    delta = known = edges if seeds is None else cut(edges.where(F.col("a").isin(seeds)), "pairs")
    step = edges.select(F.col("a").alias("b"), F.col("b").alias("c"))
    for turn in range(1, limit):
        if turn == most:
            break
        found = delta.join(step, "b").select("a", F.col("c").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        delta = cut(found, "pairs")
        if not delta.limit(1).count():
            break
        known = known.union(delta)
    else:
        raise RuntimeError(f"closure did not settle in {limit} rounds")
    if zero:
        nodes = edges.sparkSession.createDataFrame([(s,) for s in seeds], edges.select("a").schema).select("a", F.col("a").alias("b")) if seeds is not None else edges.select("a").union(edges.select("b")).distinct().select("a", F.col("a").alias("b"))
        known = known.union(nodes).distinct()
    return known


def hops(edges: DataFrame, seeds: DataFrame, depth: int, cap: int | None = None, skip: DataFrame | None = None) -> tuple[DataFrame, list[bool]]:
    """(node, hop) of the nodes within depth of the seeds (column node), over edges (a, b) in both directions.

    The first hop that sees a node counts. cap bounds the edges that one hop
    follows, in order of their ends; the second result says where it cut. Nodes
    in skip (column node) are never entered.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    if skip is not None:
        both = both.join(skip.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    seen = cut(seeds.select("node", F.lit(0).alias("hop")).distinct(), "hops")
    frontier, truncated = seen, []
    for hop in range(1, depth + 1):
        out = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi")
        if cap is not None:
            ordered = cut(out.orderBy("a", "b").limit(cap + 1), "hops")
            truncated.append(ordered.count() > cap)
            out = ordered.orderBy("a", "b").limit(cap)
        else:
            truncated.append(False)
        frontier = cut(out.select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "hops")
        seen = seen.union(frontier)
    return seen, truncated


def elect(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(root, node, indegree) of each cluster's canonical node: most incoming edges, then the least name.

    members: (node, root); edges: (a, b) without self loops counted. One node of
    each cluster is found by a partially aggregated maximum, whatever its size.
    """
    inward = edges.where("a <> b").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("indegree"))
    ranked = members.join(inward, "node", "left").select("root", "node", F.coalesce("indegree", F.lit(0)).alias("indegree"))
    best = ranked.groupBy("root").agg(F.min(F.struct((-F.col("indegree")).alias("minus"), "node")).alias("m"))
    return best.select("root", F.col("m.node").alias("node"), (-F.col("m.minus")).alias("indegree"))


def status(members: DataFrame, elected: DataFrame, marked: DataFrame) -> DataFrame:
    """(root, canonical, status, size): one explicit marker wins (graph), several conflict, none falls back (derived).

    marked: nodes (column node) with an explicit marker; those in no cluster are clusters of one.
    """
    alone = marked.join(members, "node", "left_anti").select("node", F.col("node").alias("root"))
    every = members.select("node", "root").union(alone)
    marks = marked.select("node").distinct().withColumn("mark", F.lit(1))
    joined = every.join(marks, "node", "left").groupBy("root").agg(F.count("*").alias("size"), F.coalesce(F.sum("mark"), F.lit(0)).alias("marks"), F.min(F.when(F.col("mark") == 1, F.col("node"))).alias("explicit"))
    out = joined.join(elected.select("root", F.col("node").alias("first")), "root", "left")
    kind = F.when(F.col("marks") == 1, "graph").when(F.col("marks") > 1, "conflict").otherwise("derived")
    return out.select("root", F.when(F.col("marks") == 1, F.col("explicit")).otherwise(F.coalesce("first", "explicit")).alias("canonical"), kind.alias("status"), "size")


def same_as(triples: DataFrame, members: DataFrame, predicate: str) -> DataFrame:
    """What identity adds to triples (s, p, o): all pairs of a cluster, and every member's other statements for all members.

    The closed form of symmetry, transitivity and property propagation; only
    deductions are returned. Its size is that of the answer: the sum of squares of
    the cluster sizes, and of size times statements. Keep `members` and expand on
    request where that is too much.
    """
    a, b = members.select("root", F.col("node").alias("s")), members.select("root", F.col("node").alias("t"))
    pairs = a.join(b, "root").select("s", F.lit(predicate).alias("p"), F.col("t").alias("o"))
    own = triples.where(F.col("p") != predicate).join(members.withColumnRenamed("node", "s"), "s").select("root", "p", "o").distinct()
    spread = own.join(a, "root").select("s", "p", "o")
    return pairs.union(spread).distinct().join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def latest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key by a time column, by window."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def method_counts(items: DataFrame, methods: DataFrame, key: list[str]) -> DataFrame:
    """(method, n): items by method; several methods, in rows or joined by |, count for each, none as unknown."""
    each = methods.select(*key, F.explode(F.split("method", r"\|")).alias("method")).select(*key, F.trim("method").alias("method")).where("method <> ''").distinct()
    return items.distinct().join(each, key, "left").groupBy(F.coalesce("method", F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"))
