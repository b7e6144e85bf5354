"""Entity resolution: label similarity, blocked pairs, bands, and the runs that record them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions.text import label_key
from quadrille.operators import labels
from quadrille.plans.lineage import cut

#: Pairs from HIGH on are the same; from LOW on a judge decides.
HIGH, LOW = 0.92, 0.75


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's ratio with half transpositions kept, and up to four leading characters always credited."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    left, right = [], []
    for i, c in enumerate(a):
        free = places.get(c, [])
        j = next((j for j in free if i - reach <= j <= i + reach), None)
        if j is not None:
            free.remove(j)
            left.append(c)
            right.append(j)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(c != b[j] for c, j in zip(left, sorted(right), strict=True)) / 2
    ratio = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return ratio + same * 0.1 * (1 - ratio)


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of every pair, a character of all left labels at a time."""
    out = np.zeros(len(a))
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        # Pairs of about one length, some million characters at most.
        some = order[at : at + max(1, 1_000_000 // max(1, int(size[order[min(at + 4095, len(order) - 1)]]) + 1))][:4096]
        out[some] = _jaro_winkler_block([a[i] for i in some], [b[i] for i in some])
        at += len(some)
    return out


def _codes(x: list[str], width: int) -> np.ndarray:
    return np.array(x, f"<U{width}").view(np.uint32).reshape(len(x), width)


def _jaro_winkler_block(a: list[str], b: list[str]) -> np.ndarray:
    la, lb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    wide = max(1, int(la.max()), int(lb.max()))
    x, y = _codes(a, wide), _codes(b, wide)
    place, rows = np.arange(wide), np.arange(len(a))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    free, left = place < lb[:, None], np.zeros(x.shape, bool)
    for i in range(int(la.max(initial=0))):
        fits = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach) & (i < la)[:, None]
        j = fits.argmax(1)
        hit = fits[rows, j]
        left[hit, i] = True
        free[rows[hit], j[hit]] = False
    right = ~free & (place < lb[:, None])
    m = left.sum(1)
    one, two = (np.take_along_axis(c, np.argsort(~used, axis=1, kind="stable"), 1) for c, used in ((x, left), (y, right)))
    moved = ((one != two) & (place < m[:, None])).sum(1) / 2
    some = np.maximum(m, 1)
    ratio = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / some) / 3, 0.0)
    same = np.zeros(len(a), np.int64)
    for i in range(min(4, wide)):
        same += (same == i) & (x[:, i] == y[:, i]) & (i < np.minimum(la, lb))
    score = np.where(m > 0, ratio + same * 0.1 * (1 - ratio), 0.0)
    return np.where((la == lb) & (x == y).all(1), 1.0, score)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    there = a.notna() & b.notna()
    out = pd.Series(np.nan, a.index, dtype="float64")
    if there.any():
        out[there] = jaro_winkler_pairs(a[there].tolist(), b[there].tolist())
    return out.astype(object).where(there, None)


def alike(left: DataFrame, right: DataFrame, least: float = LOW, few: int = 100_000_000) -> DataFrame:
    """(key_a, key_b, score) of all pairs of different labels with a score from `least`, above 0, on.

    Labels are compared as distinct keys, so a hot label is one row; equal labels
    need no comparison. Jaro's ratio is at most (m / |a| + m / |b| + 1) / 3 with m
    characters in common, and a common head of s characters credits s tenths of the
    rest. So only pairs with enough characters in common are looked at further.

    Keys are dealt by hash into blocks, and each pair of blocks that asks for pairs is
    one group, so every pair meets in one place, a group has as many keys whatever
    the labels are, and no head, length or character is hot. The work is by pair of
    labels of fitting lengths, but a pair that can't reach the score costs some ten
    nanoseconds and makes no row. few: about so many pairs are one group's, at most.
    """
    keyed = lambda df, a, b: df.select(label_key(F.col("label")).alias("key"), F.lit(a).alias("in_a"), F.lit(b).alias("in_b"))
    # One table on both sides is read once.
    both = keyed(left, True, True) if left is right else keyed(left, True, False).union(keyed(right, False, True))
    keys = cut(both.where("key <> ''").groupBy("key").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")), "keys")
    return alike_candidates(keys, least, few).where(F.col("score") >= least)


#: Rows that a block has at least, and characters at most, about.
_BLOCK_ROWS, _BLOCK_CHARS = 256, 8_000_000


def _blocks(keys: DataFrame, few: int) -> tuple[list[tuple[bool, bool, int, int]], dict[int, list[int]]]:
    """Blocks of the keys of the left side, of the right one and of both: (in_a, in_b, first number, how many); and which ones each meets."""
    sizes = sorted(keys.groupBy("in_a", "in_b").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("chars")).collect())
    cores, kinds, first = keys.sparkSession.sparkContext.defaultParallelism, [], 0
    for in_a, in_b, n, chars in sizes:
        tasks = min(math.ceil(math.sqrt(8 * cores)), math.ceil(n / 1000))
        many = max(1, tasks, math.ceil(n / max(_BLOCK_ROWS, math.isqrt(few))), math.ceil(chars / _BLOCK_CHARS))
        kinds.append((in_a, in_b, first, many))
        first += many
    meets = {k: [b for c, d, start, many in kinds if in_a and d or in_b and c for b in range(start, start + many)] for in_a, in_b, k, _ in kinds}
    return kinds, meets


def alike_candidates(keys: DataFrame, least: float, few: int = 100_000_000) -> DataFrame:
    """(key_a, key_b, score) of the pairs of keys (key, in_a, in_b) whose score alike computes; no pair is lost or found twice."""
    kinds, meets = _blocks(keys, few)
    if not kinds or not any(meets.values()):
        return keys.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0.0).alias("score")).limit(0)
    own, met = F.lit(None).cast("int"), F.lit(None).cast("array<int>")
    for in_a, in_b, start, many in kinds:
        here = (F.col("in_a") == in_a) & (F.col("in_b") == in_b)
        own = F.when(here, (F.pmod(F.xxhash64("key"), F.lit(many)) + start).cast("int")).otherwise(own)
        met = F.when(here, F.lit(meets[start]).cast("array<int>")).otherwise(met)
    dealt = keys.select("key", "in_a", "in_b", own.alias("own"), F.explode(met).alias("other"))
    cells = len({(min(b, c), max(b, c)) for _, _, start, many in kinds for b in range(start, start + many) for c in meets[start]})
    groups = dealt.select("key", "in_a", "in_b", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).repartition(min(2 * cells, 4000), "x", "y")

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf["own"] == pdf[c].iloc[0]] for c in "xy")
        p = labels.Labels(x["key"].tolist())
        q = p if pdf["x"].iloc[0] == pdf["y"].iloc[0] else labels.Labels(y["key"].tolist())
        (a, b), (c, d) = [(bool(z["in_a"].any()), bool(z["in_b"].any())) for z in (x, y)]  # a block's keys are of one kind
        out = [pd.DataFrame({"key_a": pd.Series(dtype=str), "key_b": pd.Series(dtype=str), "score": pd.Series(dtype=float)})]
        for i, j, there, back in labels.scored(p, q, least, jaro_winkler_pairs) if len(x) and len(y) else ():
            for ask, score, (u, f), (v, t) in ((a and d, there, (p, i), (q, j)), (c and b, back, (q, j), (p, i))):
                if ask and (ways := score > 0).any():
                    out.append(pd.DataFrame({"key_a": [u.keys[k] for k in f[ways]], "key_b": [v.keys[k] for k in t[ways]], "score": score[ways]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return groups.groupBy("x", "y").applyInPandas(compared, "key_a string, key_b string, score double")


def resolve(new: DataFrame, known: DataFrame, top: int = 100) -> DataFrame:
    """(iri, other, score, method, band) for the new entities (iri, label) among themselves and against known ones.

    exact: equal keys; high: from HIGH on; judge: from LOW on. All pairs within the
    batch are compared, and a pair is given once, smaller iri first, and only if exact
    or high; against known entities the `top` candidates of each new one by shared
    words, rare ones first, are looked at. The same iri is no pair; a label without
    letters or digits pairs with nothing.
    """
    keyed = lambda df: df.select("iri", label_key(F.col("label")).alias("key"), "label").where("key <> ''")
    n, k = keyed(new), keyed(known.join(new.select("iri"), "iri", "left_anti"))
    other = n.select(F.col("iri").alias("other"), F.col("key").alias("key_b"))
    same = n.select("iri", F.col("key").alias("key_b")).join(other, "key_b").select("iri", "other", F.lit(1.0).alias("score"))
    near = n.select("iri", F.col("key").alias("key_a")).join(alike(n, n, HIGH), "key_a").join(other, "key_b").select("iri", "other", "score")
    inside = same.union(near).where("iri < other")
    outside = _outside(n, k, top).select("iri", "other", "score")
    both = inside.union(outside).distinct()
    band = F.when(F.col("score") == 1.0, "exact").when(F.col("score") >= HIGH, "high").otherwise("judge")
    return both.withColumn("method", F.when(F.col("score") == 1.0, "exact-label").otherwise("jaro-winkler")).withColumn("band", band)


def _outside(n: DataFrame, k: DataFrame, top: int) -> DataFrame:
    """(iri, other, score, key_a) from LOW on of new entities (iri, key) and their candidates among known ones.

    Entities of equal words have equal candidates, and of known ones with equal words
    the first `top` by iri come before the others; so classes of equal words are
    weighed, not entities, however many copies there are.
    """

    def classes(df: DataFrame, name: str) -> DataFrame:
        words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("key", " ")))))
        return cut(df.groupBy("iri").agg(F.array_join(words, " ").alias(name)), "classes")

    asked, known = classes(n, "query_id"), classes(k, "id")
    sizes = known.groupBy("id").agg(F.count("*").alias("size"))
    order = Window.partitionBy("id").orderBy("iri")
    first = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).drop("r")
    queries = asked.select("query_id").distinct()
    found = top_candidates(queries.withColumn("label", F.col("query_id")), sizes.withColumn("label", F.col("id")), top, sizes=sizes)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "iri"))
    ranked = found.join(first, "id").withColumn("r", best).where(F.col("r") <= top).select("query_id", F.col("iri").alias("other"))
    keys = n.join(asked, "iri").select("query_id", F.col("key").alias("key_a")).distinct()
    met = cut(ranked.join(keys, "query_id").join(k.select(F.col("iri").alias("other"), F.col("key").alias("key_b")), "other"), "met")
    pairs = met.select("key_a", "key_b").distinct()
    score = F.when(F.col("key_a") == F.col("key_b"), F.lit(1.0)).otherwise(similarity("key_a", "key_b"))
    scores = pairs.withColumn("score", score).where(F.col("score") >= LOW)
    ends = met.join(scores, ["key_a", "key_b"]).select("query_id", "key_a", "other", "score")
    return n.join(asked, "iri").select("iri", F.col("key").alias("key_a"), "query_id").join(ends, ["query_id", "key_a"]).select("iri", "other", "score", "key_a")


def telemetry(new: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of one run: entities, exact, high and judged pairs, and entities without any."""
    touched = pairs.select("iri").union(pairs.select("other")).distinct()
    none = new.select("iri").join(touched, "iri", "left_anti").agg(F.count("*").alias("no_candidate"))
    counts = pairs.agg(*(F.count_if(F.col("band") == b).alias(b) for b in ("exact", "high", "judge")))
    return new.agg(F.count("*").alias("total")).crossJoin(counts).crossJoin(none)  # one row each


def judged(pairs: DataFrame, judge, batch: int = 50, least: float = 0.8) -> DataFrame:
    """The pairs of the judge band that judge accepts.

    judge takes a list of (iri, other, score) and returns as many (same, confidence);
    a batch it fails on is skipped.
    """

    def run(frames):
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                try:
                    said = judge(list(part[["iri", "other", "score"]].itertuples(index=False, name=None)))
                except Exception:  # a judge is an outside service
                    continue
                keep = [bool(same) and confidence >= least for same, confidence in said]
                yield part[keep]

    return pairs.where("band = 'judge'").mapInPandas(run, pairs.schema)


def top_candidates(queries: DataFrame, docs: DataFrame, top: int = 100, common: float = 0.25, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each query (query_id, label) the entries (id, label) whose shared words weigh most.

    A word weighs ln(1 + entries / entries that have it). Words that more than
    `common` of all entries have are left for last: entries without a rarer word of
    the query weigh at most the sum of its common ones, so where `top` entries weigh
    more without them, only entries near these are looked up in the common words'
    long lists. Other queries are answered in full; no result depends on `common`.
    sizes: (id, size) where an entry stands for so many; then the entries that have
    one of the `top` are given, ties whole, as only the caller knows the order in them.
    """

    def worded(df, key):
        return df.select(key, F.explode(F.array_distinct(F.split(F.lower("label"), "[^a-z0-9]+"))).alias("word")).where("word <> ''")  # those of label_key

    asked = cut(worded(queries, "query_id").distinct(), "asked")
    entries = (docs.select("id").distinct() if sizes is None else sizes).agg((F.count("*") if sizes is None else F.sum("size")).alias("entries"))
    # Only words that are asked for leave the entries.
    lists = cut(worded(docs, "id").join(asked.select("word").distinct(), "word", "left_semi").distinct(), "postings")
    weights = (lists if sizes is None else lists.join(sizes, "id")).groupBy("word").agg((F.count("*") if sizes is None else F.sum("size")).alias("df")).crossJoin(entries)  # one row
    known = cut(asked.join(weights, "word").select("query_id", "word", F.log1p(F.col("entries") / F.col("df")).alias("weight"), (F.col("df") > common * F.col("entries")).alias("usual")), "weights")
    rare, usual = known.where("not usual"), known.where("usual")
    first = cut(rare.join(lists, "word").groupBy("query_id", "id").agg(F.sum("weight").alias("part")), "rare")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part")))
    floor = first.withColumn("n", rank).where(F.col("n") == top).select("query_id", F.col("part").alias("floor"))
    rest = usual.groupBy("query_id").agg(F.sum("weight").alias("rest"))
    bounds = known.select("query_id").distinct().join(rest, "query_id", "left").join(floor, "query_id", "left").select("query_id", F.coalesce("rest", F.lit(0.0)).alias("rest"), "floor", F.coalesce(F.col("floor") > F.coalesce("rest", F.lit(0.0)) + 1e-6, F.lit(False)).alias("sure"))
    bounds = cut(bounds, "bounds")
    near = first.join(bounds.where("sure"), "query_id").where("part + rest >= floor - 1e-6").select("query_id", "id", "part")
    more = near.join(usual, "query_id").join(lists, ["id", "word"]).select("query_id", "id", "weight")
    full = known.join(bounds.where("not sure"), "query_id", "left_semi").join(lists, "word").select("query_id", "id", "weight")
    scored = near.select("query_id", "id", F.col("part").alias("weight")).union(more).union(full).groupBy("query_id", "id").agg(F.round(F.sum("weight"), 6).alias("score"))
    if sizes is not None:
        # As many as stand for more before them give all there are.
        before = F.coalesce(F.sum("size").over(Window.partitionBy("query_id").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("size").over(Window.partitionBy("query_id", "score")), F.lit(0))
        return scored.join(sizes, "id").withColumn("before", before).where(F.col("before") < top).drop("size", "before")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", best).where(F.col("rank") <= top)
