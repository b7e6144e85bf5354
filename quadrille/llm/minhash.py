"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingles gives two signature values, its minimum and
its maximum, so a signature of 2p values costs p hash evaluations per shingle.
The values are banded; documents that share a band are candidates, and every
link that is reported was confirmed by the exact Jaccard ratio of full sets.

No bucket is expanded into its pairs. Equal sets are one class from the start,
however many documents have them, and only classes are compared. The members of a bucket are first compared with one hub; members that are then
in the hub's component need no more pairs, and the others meet further hubs.
What is still apart after that is settled exactly by prefix filtering: with
shingles ordered by rarity, two sets that are similar enough share one of their
first few, so only documents that share a rare shingle are compared. A heavily
edited copy has rare shingles of its own and meets nobody. No link is lost to
the choice of hubs. With the default bands, a pair exactly at the threshold of
0.85 fails to share one about once in 10^8.

A hub's set is sent once for each `CHUNK` of the members that it is compared with.

Rows: null text counts as empty; a document without words has an empty set and
is its own component; documents with fewer words than a shingle have one
shingle, the whole sequence; equal texts are linked; rows that repeat a doc_id
are linked by it, each with its own text; rows with a null doc_id are documents
that come last, so their component is null unless they are linked to others; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.columns import unused
from quadrille.llm.kernels import as_long, mix, released, slices, text_bytes, windows, words
from quadrille.plans.components import connected_components
from quadrille.plans.lineage import cut

NULL_IDS = (1 << 63) - (1 << 44)  # row ids of texts without a doc_id, after all others
CHUNK = 256  # members that one copy of a hub's set serves


@dataclass(frozen=True)
class MinMax:
    """shingle: words in one; percent: least Jaccard ratio in hundredths; bands of rows values."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    seed: int = 17

    def multipliers(self) -> np.ndarray:
        r = np.random.default_rng(self.seed)
        return r.integers(0, 1 << 64, ((self.bands * self.rows + 1) // 2, 2), np.uint64) | np.array([1, 0], np.uint64)


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes row by row, and their number for each row."""
    w = words(data, at, lower=True)
    counts = np.diff(w.first)
    out, keep = np.zeros(len(w.hashes), np.uint64), np.zeros(len(w.hashes), bool)
    full = windows(w.hashes, k)
    out[: len(full)] = full
    keep[: len(full)] = np.repeat(w.first[1:], counts)[: len(full)] - np.arange(len(full)) >= k
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        i, n = int(w.first[d]), int(counts[d])
        out[i], keep[i] = windows(w.hashes[i : i + n], n, salt=100 + n)[0], True
    return out[keep], np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))


def distinct(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each row."""
    ends = np.cumsum(counts)
    return [np.unique(hashes[e - n : e]) for e, n in zip(ends, counts, strict=True)]


def sketch(batch: pa.RecordBatch, p: MinMax) -> pa.RecordBatch:
    data, at = text_bytes(batch.column("text"))
    hashes, counts = shingles(data, at, p.shingle)
    sets = distinct(hashes, counts)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(counts)
    fp = np.zeros((2, len(sets)), np.uint64)
    keys = np.zeros((len(sets), p.bands), np.uint64)
    if len(some):
        flat, starts = np.concatenate([sets[d] for d in some]), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        for i, salt in enumerate((0x51ED270B5A1F39C5, 0x7C3A8D1E96B40F2B)):
            fp[i, some] = np.add.reduceat(mix(flat ^ np.uint64(salt)), starts)
        values = []
        for a, b in p.multipliers():
            x = flat * a + b
            values += [np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)]
        for band in range(p.bands):
            h = np.full(len(some), band + 1, np.uint64)
            for v in values[band * p.rows : (band + 1) * p.rows]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + v)
            keys[some, band] = h
    where = np.where(counts > 0, p.bands, 0)
    offsets = np.concatenate([[0], np.cumsum(where)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(sizes), as_long(fp[0]), as_long(fp[1]), pa.ListArray.from_arrays(pa.array(offsets), as_long(keys[counts > 0].ravel()))],
        ["doc_id", "n_shingles", "fp1", "fp2", "keys"],
    )


def _row() -> Column:
    """The doc_id; without one, a number of the text's own from NULL_IDS on, after other ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_IDS) + F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit((1 << 63) - NULL_IDS)))


def _class() -> Column:
    """The number of a set: equal sets have the same."""
    return F.xxhash64("fp1", "fp2", "n_shingles")


def sketches(docs: DataFrame, p: MinMax) -> DataFrame:
    """doc_id, n_shingles, keys (one for each band), row and node (the class of the set)."""

    def run(batches):
        for batch in slices(batches, size=1 << 19):
            made = sketch(batch, p)
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column("row")], [*made.schema.names, "row"])

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _row().alias("row")).mapInArrow(released(run), "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>, row long")
    return made.select("doc_id", "n_shingles", "keys", "row", _class().alias("node"))


def _sets(docs: DataFrame, classes: DataFrame, p: MinMax) -> DataFrame:
    """The full sets of some classes, from the rows that stand for them: node, members (sorted hashes, little-endian)."""

    def run(batches):
        for batch in slices(batches):
            made = sketch(batch, MinMax(p.shingle, p.percent, 0, 0, p.seed))
            sets = distinct(*shingles(*text_bytes(batch.column("text")), p.shingle))
            yield pa.RecordBatch.from_arrays([*(made.column(c) for c in ("fp1", "fp2", "n_shingles")), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp1", "fp2", "n_shingles", "members"])

    rows = docs.select(F.col("doc_id").cast("long"), _row().alias("row"), F.col("text").cast("string").alias("text")).join(classes.select("row"), "row", "left_semi")
    return rows.select("doc_id", "text").mapInArrow(released(run), "fp1 long, fp2 long, n_shingles long, members binary").select(_class().alias("node"), "members")


def _confirm(pairs: DataFrame, sets: DataFrame, p: MinMax) -> DataFrame:
    """a, b and whether their sets are similar enough. The copies of a's set stand before the members they serve."""

    def run(batches):
        at = hub = None
        for batch in batches:
            a, b, linked = [], [], []
            for x, slot, y, members in zip(*(batch.column(c).to_pylist() for c in ("a", "slot", "b")), batch.column("members"), strict=True):
                if y is None:
                    at, hub = (x, slot), np.frombuffer(members.as_buffer(), np.uint64)
                elif at == (x, slot):
                    v = np.frombuffer(members.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([hub, v]), kind="stable")
                    inter = int(np.count_nonzero(both[1:] == both[:-1]))
                    a.append(x)
                    b.append(y)
                    linked.append(100 * inter >= p.percent * (len(both) - inter))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    pairs = cut(pairs, "candidates")
    # Written first, so that the join of a hot hub's pairs is one that skew handling can split.
    slots = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("slots")), "slots")
    members = pairs.join(slots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"), "b").join(sets.withColumnRenamed("node", "b"), "b")
    hubs = slots.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("long").alias("b"), "members")
    both = hubs.union(members.select("a", "slot", "b", "members")).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return both.mapInArrow(released(run), "a long, b long, linked boolean")


def _ordered(df: DataFrame, x: str, y: str, p: MinMax, nx: str, ny: str) -> DataFrame:
    """Pairs of different nodes whose set sizes allow a link, smaller node first."""
    fits = (100 * F.least(nx, ny) >= p.percent * F.greatest(nx, ny)) & (F.col(x) != F.col(y))
    return df.where(fits).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _rare_pairs(sets: DataFrame, nodes: DataFrame, p: MinMax) -> DataFrame:
    """Pairs of nodes in different components that share a shingle among their rarest.

    Sets of x and y members need an overlap of t(x+y)/(1+t), so they share one of
    the first x-overlap+1 and y-overlap+1 in any common order of the shingles.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                members = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("members")]
                n = np.array([len(x) for x in members], np.int64)
                each = [np.repeat(part.column(c).to_numpy(), n) for c in ("node", "root")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(np.repeat(n, n)), pa.array(np.concatenate(members))], ["node", "root", "n", "token"])

    t = p.percent
    token = cut(sets.join(nodes.drop("n"), "node").select("node", "root", "members").mapInArrow(released(run), "node long, root long, n long, token long"), "tokens")
    df = token.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "token"))
    ranked = cut(token.join(df, "token").withColumn("rank", rank).where(f"100 * rank <= (100 - {t}) * n + 100 and df > 1").select("token", "node", "root", "n", "rank"), "rare")
    other = ranked.select("token", *(F.col(c).alias(f"o_{c}") for c in ("node", "root", "n", "rank")))
    need = f"ceil({t} * (n + o_n) / {100 + t}.0D - 1e-9)"
    return ranked.join(other, "token").where(f"root < o_root and rank <= n - {need} + 1 and o_rank <= o_n - {need} + 1").select("node", "n", "o_node", "o_n")


def near_components(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    seen = cut(sketches(docs, p), "sketch")
    some = seen.where("n_shingles > 0")
    classes = cut(some.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least")), "classes")
    banded = some.select(F.explode("keys").alias("key"), "node", F.col("n_shingles").alias("n")).groupBy("key", "node").agg(F.max("n").alias("n"))
    shared = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    together = cut(banded.join(shared, "key"), "shared")
    # The class that meets most others is the likeliest to be what its copies were made from.
    sizes = cut(together.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    weight = together.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("met"))
    member = cut(together.join(weight, "node"), "buckets")
    # Rows that repeat a doc_id with other words are linked by it.
    own = some.where("doc_id is not null").groupBy("doc_id", "node").agg(F.lit(1).alias("one"))
    first = cut(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z"), "repeated")
    by_id = own.join(first, "doc_id").where("a < node").select("a", F.col("node").alias("b"))
    roots = _link(docs, member, classes, by_id, p)
    rooted = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = cut(rooted.join(least, "root").select("node", "component_id"), "labels")
    found = some.join(label, "node").select("doc_id", "n_shingles", "component_id")
    alone = seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _link(docs: DataFrame, member: DataFrame, classes: DataFrame, by_id: DataFrame, p: MinMax) -> DataFrame:
    """(node, root) of the classes that have a confirmed link."""
    spark = docs.sparkSession
    sets = cut(_sets(docs, classes.join(member.select("node").distinct(), "node", "left_semi"), p).dropDuplicates(["node"]), "sets")
    tested = None
    links = cut(by_id, "links")
    roots = connected_components(links) if links.limit(1).count() else spark.createDataFrame([], "node long, root long")
    for turn in range(4):
        state = member.join(roots, "node", "left").select("key", "node", "n", "met", F.coalesce("root", "node").alias("root"))
        if turn == 3:
            split = state.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
            wide = _rare_pairs(sets, state.join(split, "key").groupBy("node").agg(F.max("n").alias("n"), F.first("root").alias("root")), p)
        else:
            order = -F.col("met") if turn < 2 else F.xxhash64("node", F.lit(turn))
            hubs = cut(state.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n", "root")).alias("h")), "hubs")
            wide = state.join(hubs, "key").select("key", "node", "n", "root", F.col("h.node").alias("o_node"), F.col("h.n").alias("o_n"), F.col("h.root").alias("o_root")).where("root <> o_root")
        pairs = _ordered(wide, "node", "o_node", p, "n", "o_n")
        if turn == 0:  # one hub each: that with which it shares most bands
            pairs = pairs.groupBy("a", "b").count().groupBy("b").agg(F.max(F.struct("count", (-F.col("a")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("a"), "b")
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        now = cut(_confirm(pairs, sets, p), "pairs")
        new = now.where("linked").select("a", "b")
        tested = now.select("a", "b") if tested is None else tested.union(now.select("a", "b"))
        if not new.limit(1).count():
            continue
        links = links.union(new)
        roots = connected_components(links)
    return roots


def keep_one(docs: DataFrame, p: MinMax = MinMax()) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id; of rows that repeat it, that with the least hash of its text. Rows with a null doc_id stay, once for each text."""
    kept = near_components(docs, p).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    once = docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi").union(docs.where("doc_id is null"))
    # Names that no column of docs has.
    text, place = (unused(docs, x) for x in ("text", "place"))
    named = once.withColumn(text, F.xxhash64("text"))
    alone = F.when(F.col("doc_id").isNull(), F.col(text))
    return named.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", alone).orderBy(text))).where(F.col(place) == 1).drop(text, place)

