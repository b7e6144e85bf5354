"""Removal of long repeated passages by compaction of a sparse de Bruijn graph.

A window of `length` words is removed from a document if its word sequence also
starts in a document with a smaller doc_id. Of all k-mers with k = length // 2,
only those are nodes that are least in some run of length - k + 1 neighbours, so
every window holds one and equal windows hold the same. Nodes seen in several
documents are joined in text order by edges that carry their distance, which is
at most k, so equal edges mean equal text. Where a node and its neighbour occur
exactly as often as the edge between them, the path does not branch. Such edges
form chains, which are compacted by joins of the edge table with itself: every
node jumps back along the chain by twice the distance in each round, until it
knows the chain's head and its offset from there. A chain is then a repeated
span in every document that has its head; the coordinates of all its nodes in
the document are checked before the span is believed.

Windows at the ends of such spans, and between them, are compared one by one by
hash, with their source coordinates, so the result is exact up to collisions of
64-bit hashes. Only windows whose own least k-mer is a repeated node are ever
looked at. Hot passages are counted before they are shuffled; what is joined to
the counts comes straight from an exchange that skew handling can split, as the
counts are written first. Rows of one document meet in one task.

Rows: a null text has no words; documents below `length` words lose nothing; of
equal documents the smallest doc_id keeps its words; rows that repeat a doc_id
are the same document and don't remove from each other; a null doc_id is neither
source nor target; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.kernels import as_long, slices, text_bytes, windows, words
from quadrille.plans.lineage import cut, discard


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n consecutive values, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out = f(out[: len(out) - width], out[width:])
        width *= 2
    return f(out[: len(out) - (n - width)], out[n - width :]) if width < n else out


def nodes(hashes: np.ndarray, ends: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the sparse nodes, their k-mer hashes, and every window's least k-mer (0 over a document's end).

    ends: where each word's document ends.
    """
    run = length - k + 1
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    mers = windows(hashes, k)
    least = _slide(mers, run, np.minimum)
    least[np.arange(len(least)) + length > ends[: len(least)]] = 0  # windows over a document's end
    around = _slide(np.concatenate([np.zeros(run - 1, np.uint64), least, np.zeros(run - 1, np.uint64)]), run, np.maximum)
    at = np.flatnonzero((around[: len(mers)] == mers) & (mers != 0))
    return at, mers[at], least


def _parsed(batch: pa.RecordBatch):
    w = words(*text_bytes(batch.column("text")))
    return w, np.repeat(w.first[1:], np.diff(w.first))


def _find(docs: DataFrame, k: int, length: int) -> DataFrame:
    """Every node of every document: h (of the k-mer), doc_id, th, pos."""

    def run(batches):
        for batch in slices(batches):
            w, ends = _parsed(batch)
            at, h, _ = nodes(w.hashes, ends, k, length)
            doc = np.searchsorted(w.first, at, "right") - 1
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([as_long(h), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array((at - w.first[doc]).astype(np.int32))], ["h", "doc_id", "th", "pos"])

    return docs.where("doc_id is not null").mapInArrow(run, "h long, doc_id long, th long, pos int")


def _repeated(found: DataFrame) -> DataFrame:
    """The nodes that several documents have, with their earliest document and how often they occur."""
    found = cut(found, "kmers")
    seen = cut(found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi"), "seen")
    return cut(found.join(seen, "h"), "nodes")


def chain_edges(nodes: DataFrame, k: int) -> DataFrame:
    """h, h2, gap: the edges that every occurrence of either end has."""
    text = Window.partitionBy("doc_id", "th").orderBy("pos")
    ahead = nodes.select("*", *(F.lead(x).over(text).alias(f"{x}2") for x in ("h", "n")), (F.lead("pos").over(text) - F.col("pos")).alias("gap"))
    return ahead.where(f"n = n2 and gap between 1 and {k}").groupBy("h", "h2", "gap").agg(F.count("*").alias("m"), F.max("n").alias("n")).where("m = n").select("h", "h2", "gap")


def compact(edges: DataFrame) -> DataFrame:
    """h, head, off: the head of each node's chain and how far it is behind it; heads are not listed.

    A chain of n nodes takes about log n rounds. Chains can't close: every
    occurrence of a node has the next one behind it in the same document.
    """
    at = cut(edges.select(F.col("h2").alias("h"), F.col("h").alias("head"), F.col("gap").alias("off")), "chains")
    while True:
        back = at.select(F.col("h").alias("head"), F.col("head").alias("far"), F.col("off").alias("more"))
        step = at.join(back, "head", "left").select("h", F.coalesce("far", "head").alias("head"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("far").isNotNull().alias("moved"))
        step = cut(step, "chains")
        discard(at)
        if not step.where("moved").limit(1).count():
            return step.drop("moved")
        at = step


def _paths(found: DataFrame, k: int, length: int) -> DataFrame:
    """Per document, where its repeated nodes are, and the chains of `length` words or more in it: pos, length and earliest document."""
    nodes = _repeated(found)
    inner = compact(chain_edges(nodes, k))
    chains = inner.groupBy("head").agg((F.max("off") + k).alias("length"), (F.count("*") + 1).alias("links")).where(f"length >= {length}")
    member = cut(inner.join(chains, "head").union(chains.select(F.col("head").alias("head"), F.col("head").alias("h"), F.lit(0).alias("off"), "length", "links")), "members")
    own = ["doc_id", "th"]
    placed = nodes.join(member, "h").groupBy(*own, "head", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("found"), F.max("links").alias("links"), F.max("length").alias("length"), F.min("lo").alias("lo"), F.max("off").alias("last"))
    spans = placed.where(f"found = links and last + {k} = length").select(*own, F.lit(None).cast("int").alias("pos"), F.struct(F.col("start").alias("pos"), "length", "lo").alias("span"))
    every = nodes.select(*own, "pos", F.lit(None).cast(spans.schema["span"].dataType).alias("span")).union(spans)
    return every.groupBy(*own).agg(F.collect_set("pos").alias("at"), F.sort_array(F.collect_set("span")).alias("path"))


def _covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:n]) > 0


def _result(doc, removed: np.ndarray | None, parts: list[bytes]) -> tuple:
    kept = parts if removed is None else [p for p, r in zip(parts, removed.tolist(), strict=True) if not r]
    return doc, len(parts), len(parts) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _split(docs: DataFrame, k: int, length: int) -> DataFrame:
    """Finished rows of documents without repeats; for the others the text, what paths cover and the windows to compare."""
    window = pa.list_(pa.struct([("pos", pa.int32()), ("a", pa.int64())]))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "th", "text", "spans", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32()), window]

    def one(doc, th, text, repeated, path):
        if not repeated:
            return *_result(doc, None, (text or "").encode().split()), None, None, None, None
        raw = text.encode()
        w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        n, spans, test = len(w.hashes), [], np.zeros(len(w.hashes), bool)
        # A window can only be found elsewhere if its own least k-mer is.
        at, h, least = nodes(w.hashes, np.full(n, n), k, length)
        test[: len(least)] = np.isin(least, h[np.isin(at, repeated)])
        for x in path:
            a, b = x["pos"], x["pos"] + x["length"]
            test[a : b - length + 1] = False
            if x["lo"] < doc:
                spans += [a, b]
        test[n - length + 1 :] = False
        at = np.flatnonzero(test)
        x = windows(w.hashes, length, salt=3)[at].view(np.int64).tolist()
        return doc, n, None, None, th, text, spans, [{"pos": p, "a": u} for p, u in zip(at.tolist(), x, strict=True)]

    def run(batches):
        for batch in slices(batches):
            rows = [one(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text", "at", "path")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(run, f"{_OUT}, th long, text string, spans array<int>, windows array<struct<pos:int,a:bigint>>")


def _finish(rows: DataFrame, length: int) -> DataFrame:
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def one(doc, text, spans, hits):
        parts = text.encode().split()
        every = list(zip(spans[::2], spans[1::2], strict=True)) + [(p, p + length) for p in hits or ()]
        return _result(doc, _covered(len(parts), every), parts)

    def run(batches):
        for batch in slices(batches):
            out = [one(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "hits")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select("doc_id", "text", "spans", "hits").mapInArrow(run, _OUT)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256: the words left, joined by one space."""
    k = length // 2
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    paths = _paths(_find(plain, k, length), k, length)
    state = cut(_split(plain.join(paths, ["doc_id", "th"], "left"), k, length), "repeats")
    some = state.where("windows is not null")
    tests = some.select("doc_id", "th", F.inline("windows"))
    first = cut(tests.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a", "lo"), "first")
    hits = tests.join(first, "a").where("lo < doc_id").groupBy("doc_id", "th").agg(F.collect_set("pos").alias("hits"))
    done = _finish(some.join(hits, ["doc_id", "th"], "left"), length)
    return state.where("windows is null").select("doc_id", "n_words", "n_removed", "kept_sha256").union(done)
