"""Language-model scores by stupid backoff, computed relationally.

Documents are dealt into slices by hash. A slice explodes its texts into n-grams
and keeps each distinct one once, with how often the slice has it (the map-side
combine). These rows are dealt by n-gram hash, so that a hash partition holds the
count table of its n-grams, grouped and summed; the exploded n-grams are joined
to it there and go back to their slices, where the counts are looked up for every
word and the logarithms are summed for each document. The counts of contexts come
from the same table. On the way, a row holds the n-grams that a slice has of one
partition, as lists in the order of their hashes: 48 bits beside the number of
the partition.

Words and pairs are asked for at once, each longer n-gram in a round of its own
and only where both n-grams a word shorter in it occur elsewhere: any other has a
count of 0 without asking. Every document is scored against all others: its own
occurrences are taken off the counts first, so that text found nowhere else
backs off.

S(w | context) is c(context w) / c(context) if that n-gram occurs elsewhere, else
`discount` times S with a context shorter by a word; a single word has max(c, 1)
over the number of all words outside the document, plus one.

Rows: a null text has no words; a document without words has score 0 and null
mean; rows that repeat a document are documents of their own; results do not
depend on the partitions; an empty table gives no rows; other columns are
ignored. Hashes have 48 bits and those of the partition, 56 and more on large
tables, so counts are exact up to rare collisions. A very frequent n-gram has a
row for each slice, not for each occurrence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.kernels import mix, text_bytes, windows, words


def _grams(table: pa.Table, order: int):
    """Per order: hashes of the n-grams that end at each word (0 where the document is too short), and the words' documents."""
    w = words(*text_bytes(table.column("text")))
    doc, n = w.doc_of(), len(w.hashes)
    place = np.arange(n) - w.first[doc]
    out = []
    for k in range(1, order + 1):
        h = np.zeros(n, np.uint64)
        if n >= k:
            h[k - 1 :] = windows(w.hashes, k, salt=20 + k)
        h[place < k - 1] = 0
        out.append(h)
    return out, doc, place, np.diff(w.first)


def _distinct(h: np.ndarray):
    """Distinct nonzero hashes, how often each occurs, and each word's place among them (0 if none: masked by the caller)."""
    keys, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(keys) and keys[0] == 0:
        return keys[1:], np.maximum(inverse - 1, 0), counts[1:]
    return keys, inverse, counts


FEW = 127  # counts from here on are in a list of their own


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pyarrow.compute.list_flatten(table.column(name)).combine_chunks().to_numpy(zero_copy_only=False)


def _counts(table: pa.Table) -> np.ndarray:
    few = _flat(table, "few").astype(np.int64)
    few[few == FEW] = _flat(table, "many")
    return few


def _count_lists(counts: np.ndarray, edges: np.ndarray) -> dict[str, pa.Array]:
    much = counts >= FEW
    return {"few": _lists(np.minimum(counts, FEW).astype(np.int8), edges), "many": _lists(counts[much], np.append(0, np.cumsum(much))[edges])}


def _exploded(table: pa.Table) -> pa.Table:
    """slice, gram (the order on top, then the hash) and own: a row for each n-gram."""
    n = pyarrow.compute.list_value_length(table.column("low")).to_numpy()
    order = np.repeat(table.column("k").to_numpy(), n).astype(np.int64)
    gram = order << 48 | _flat(table, "mid").view(np.uint16).astype(np.int64) << 32 | _flat(table, "low").view(np.uint32)
    return pa.table({"slice": np.repeat(table.column("slice").to_numpy(), n), "gram": gram, "own": _counts(table)})


def _asked(grams, k: int, others, place: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of order k + 1 that are asked for, 0 elsewhere."""
    if k < 2:
        return grams[k]
    known = others[k - 1] > 0
    return np.where((place >= k) & known & np.concatenate([[False], known[:-1]]), grams[k], 0).astype(np.uint64)


def _others(grams, doc: np.ndarray, place: np.ndarray, right: pa.Table, order: int):
    """Per order: how often the n-gram that ends at each word occurs in other documents."""
    others = []
    for k in range(order):
        h = _asked(grams, k, others, place)
        _, inverse, _ = _distinct(h)
        told = _counts(right.filter(pyarrow.compute.equal(right.column("k"), k)).sort_by("part"))  # in the order of the hashes
        whole = told[inverse] if len(told) else np.zeros(len(h), np.int64)
        _, same, own = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        others.append(np.where(h != 0, whole - own[same], 0))
    return others


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def score(docs: DataFrame, order: int = 3, discount: float = 0.4, slice_chars: int = 10_000_000, part_words: int = 400_000) -> DataFrame:
    """doc_id, n_words, score (sum of log10 S) and mean (per word) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words")).first()
    slices = max(8, -(-total[0] // slice_chars))
    bits = max(4, min(26, math.ceil(math.log2(max(1, total[1] / part_words)))))
    n_all, shift = int(total[1]), np.uint64(max(0, 16 - bits))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(slices)))

    def exploded(slice_: int, orders: dict[int, np.ndarray]) -> pa.Table:
        """The distinct n-grams of a slice by partition: 32 and 16 bits of the hash, and how often each occurs."""
        out = []
        for k, h in orders.items():
            keys, _, counts = _distinct(h)
            part = keys >> np.uint64(64 - bits)
            first = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 32)))
            edges, gram = np.append(first, len(keys)), keys >> shift
            n = len(first)
            named = {"part": pa.array(part[first].astype(np.int32)), "slice": pa.array(np.full(n, slice_)), "k": pa.array(np.full(n, k, np.int32))}
            lists = {"mid": _lists((gram >> np.uint64(32)).astype(np.uint16).view(np.int16), edges), "low": _lists(gram.astype(np.uint32).view(np.int32), edges)}
            out.append(pa.table(named | lists | _count_lists(counts, edges)))
        return pa.concat_tables(out)

    def ask(table: pa.Table) -> pa.Table:
        grams, *_ = _grams(table, min(order, 2))
        return exploded(table.column("slice")[0].as_py(), dict(enumerate(grams)))

    def ask_longer(k: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            grams, doc, place, _ = _grams(left, k + 1)
            if not left.num_rows:
                return exploded(0, {k: np.zeros(0, np.uint64)})
            return exploded(left.column("slice")[0].as_py(), {k: _asked(grams, k, _others(grams, doc, place, right, k), place)})

        return run

    def counted(asked: DataFrame) -> DataFrame:
        """The counts of the n-grams of each slice, in the order of their hashes."""
        return asked.groupBy("part").applyInArrow(join_counts, tells).repartition("slice")

    def join_counts(table: pa.Table) -> pa.Table:
        grams = _exploded(table)
        table_of_counts = grams.group_by("gram", use_threads=False).aggregate([("own", "sum")])
        joined = grams.drop_columns("own").join(table_of_counts, "gram", use_threads=False).combine_chunks()
        slice_, gram, total = (joined.column(c).to_numpy() for c in ("slice", "gram", "own_sum"))
        order_ = np.argsort(gram)
        order_ = order_[np.argsort(slice_[order_], kind="stable")]
        slice_, k, total = slice_[order_], gram[order_] >> 48, total[order_]
        first = np.flatnonzero(np.append(True, (np.diff(slice_) != 0) | (np.diff(k) != 0)))
        named = {"slice": pa.array(slice_[first]), "part": pa.array(np.full(len(first), table.column("part")[0].as_py(), np.int32)), "k": pa.array(k[first].astype(np.int32))}
        return pa.table(named | _count_lists(total, np.append(first, len(total))))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, doc, place, sizes = _grams(left, order)
        value, open_ = np.zeros(len(doc)), np.ones(len(doc), bool)
        others = _others(grams, doc, place, right, order)
        rest = (n_all - sizes[doc] + 1).astype(float)
        for k in range(order - 1, 0, -1):
            here = open_ & (place >= k)
            found = here & (others[k] > 0)
            before = np.concatenate([[1], others[k - 1][:-1]])
            value[found] += np.log10(others[k][found] / np.maximum(before[found], others[k][found]))
            open_ &= ~found
            value[here & open_] += math.log10(discount)
        value[open_] += np.log10(np.maximum(others[0][open_], 1) / rest[open_])
        sums = np.bincount(doc, value, len(sizes)).astype(float)
        mean = pa.array(np.divide(sums, sizes, where=sizes > 0, out=np.zeros(len(sizes))), mask=sizes == 0)
        return pa.table([left.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(sums), mean], ["doc_id", "n_words", "score", "mean"])

    asks, tells = "part int, slice long, k int, mid array<smallint>, low array<int>, few array<tinyint>, many array<long>", "slice long, part int, k int, few array<tinyint>, many array<long>"
    told = counted(dealt.groupBy("slice").applyInArrow(ask, asks))
    for k in range(2, order):
        longer = dealt.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(ask_longer(k), asks)
        told = told.union(counted(longer))
    return dealt.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(add, "doc_id long, n_words long, score double, mean double")
