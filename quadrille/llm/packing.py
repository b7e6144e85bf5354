"""Packing documents into sequences by length patterns and non-negative least squares.

A document is its token ids and an end id. Longer ones than a sequence are cut
into whole sequences from their end on, so that only a first piece is shorter.
What is left to decide depends on lengths alone: patterns of up to three lengths
that fill a sequence exactly are enumerated, how often each is to be used is
fitted to the histogram of lengths by non-negative least squares, the numbers are
rounded, and what the rounded patterns leave over is packed best fit, longest
first, with all pieces of a length at a time. All of that works on the histogram,
which has a row for each length, however many documents there are.

Pieces then take their places by rank: the pieces of a length are dealt into small
buckets by hash, ranked within these, and a bucket's pieces follow those of the
buckets before it; the places of a length are ranges of ranks. No length, however
common, meets in one task.

Rows: a null or empty text is the end id alone; texts are encoded whole; rows that
repeat a document are documents of their own; rows equal in every column of the
result may change places with each other; an empty table gives no rows. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm.kernels import slices
from quadrille.plans.lineage import cut

#: (how many sequences, ((length, times), ...)): sequences that hold the same lengths, in this order.
Kind = tuple[int, tuple[tuple[int, int], ...]]


# -- pieces
class Encoder:
    """Ids of texts as the tokenizer in a JSON file gives them, strings of special tokens being ordinary text.

    Byte-level vocabularies whose merges come in the order of their ids are
    encoded by tiktoken, which gives the same ids in a quarter of the time; other
    files, and texts with very long runs, by the tokenizer itself.
    """

    long_run = re.compile(r"\S{2000}|\s{2000}").search

    def __init__(self, file: str, pattern: str):
        self.own = Tokenizer.from_str(file)
        self.own.encode_special_tokens = True
        self.own.no_truncation()
        self.own.no_padding()
        ranks = _ranks(json.loads(file))
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or self.long_run(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _ranks(file: dict) -> dict[bytes, int] | None:
    """The bytes of each token, if ids give the order of merges."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or file.get("normalizer"):
        return None
    # Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in file.get("added_tokens", [])}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        return None
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


def borders(n: int, size: int) -> list[int]:
    """Where the pieces of n tokens start: all but the first have `size` of them."""
    return [0, *range((n - 1) % size + 1, n, size)]


_encoders: dict[tuple[int, int, str], Encoder] = {}


def pieces(docs: DataFrame, path: str, pattern: str, size: int = 1024, end: int = 2, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document; ids: also its ids, as array<int>."""
    spark = docs.sparkSession
    if "://" in path:
        file = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()
    else:
        with open(path, encoding="utf-8") as f:
            file = f.read()
    sent = spark.sparkContext.broadcast(file)  # the vocabulary, of a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (len(sent.value), zlib.crc32(sent.value.encode()), pattern)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(sent.value, pattern)
        encode = _encoders[key]
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = np.array([*encode(text or ""), end], "<u4")
                for i, (a, b) in enumerate(zip(at := borders(len(found), size), [*at[1:], len(found)], strict=True)):
                    rows.append((doc, i, a, b - a, zlib.crc32(found[a:b].tobytes()), *([found[a:b].view("<i4")] if ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# -- patterns
def enumerate_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill `size` with one, two or three of the lengths, falling; 0 stands for none."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    out = [(size, 0, 0)] if there[size] else []
    out += [(a, size - a, 0) for a in range(size - 1, (size - 1) // 2, -1) if there[a] and there[size - a]]
    blocks = [np.array(out, np.int64).reshape(-1, 3)]
    for a in lengths[lengths >= -(-size // 3)].tolist():
        b = np.arange(-(-(size - a) // 2), min(a, size - a - 1) + 1)
        b = b[there[b] & there[size - a - b]]
        blocks.append(np.stack([np.full_like(b, a), b, size - a - b], axis=1))
    return np.concatenate(blocks)


def fit(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 40, idle: int = 4) -> np.ndarray:
    """How often each pattern is used: x >= 0 that brings the lengths used near to wanted[length], by block pivoting.

    Squared errors weigh by length, as what is left of long pieces wastes more. A
    round takes in the patterns that promise most, no two with a length in common,
    solves for all that are in, and puts out those that would be used less than
    not at all, until none is. The best of the rounds counts; `idle` rounds without
    a gain end the search. No more patterns are in than there are lengths.
    """
    n = len(patterns)
    if not n:
        return np.zeros(0)
    weight = np.arange(len(wanted)) / (len(wanted) - 1)
    target = weight * wanted

    def solved(on: np.ndarray) -> np.ndarray:
        times = np.zeros((len(wanted), len(on)))
        for column in patterns[on].T:
            np.add.at(times, (column, np.arange(len(on))), 1.0)
        times *= weight[:, None]
        times[0] = 0
        gram, right = np.zeros((len(on), len(on))), np.zeros(len(on))
        for column in patterns[on].T:  # a pattern has three lengths: no product of matrices is needed
            gram += times[column]
            right += np.where(column > 0, target[column], 0)
        gram[np.diag_indices_from(gram)] += 1e-9
        return np.linalg.solve(gram, right)

    def rest(on: np.ndarray, x: np.ndarray) -> np.ndarray:
        used = np.zeros(len(wanted))
        for column in patterns[on].T:
            used += np.bincount(column, x, len(wanted))
        used[0] = 0
        return wanted - used

    on, x = np.zeros(0, np.int64), np.zeros(0)
    best, least, waited = (on, x), np.inf, 0
    for _ in range(rounds):
        left = rest(on, x)
        error = float(weight @ left**2)
        waited = 0 if error < least * (1 - 1e-3) else waited + 1
        if error < least:
            best, least = (on, x), error
        if waited > idle or least <= 1e-9 * float(weight @ wanted**2):
            break
        slope = (weight * left)[patterns].sum(1)
        slope[on] = 0
        order = np.flatnonzero(slope > 1e-6 * slope.max())
        order = order[np.argsort(-slope[order], kind="stable")]
        taken, new = np.zeros(len(wanted), bool), []
        for i, own in zip(order.tolist(), patterns[order].tolist(), strict=True):
            a, b, c = own
            if not (taken[a] or b and taken[b] or c and taken[c]):
                taken[own] = True
                new.append(i)
        if not new:
            break
        on = np.sort(np.concatenate([on, np.array(new, np.int64)]))
        while len(on):
            x = solved(on)
            if x.min() > 0:
                break
            on = on[x > 0]
    out = np.zeros(n)
    out[best[0]] = best[1]
    return out


def best_fit(counts: np.ndarray, size: int) -> list[Kind]:
    """Sequences for counts[length] pieces, longest first, each into the fullest sequence with room, all of a length at a time."""
    open_: dict[int, list[list]] = {}  # room left: [how many, content]
    rooms: list[int] = []

    def put(room: int, many: int, content: tuple) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([many, content])

    done: list[Kind] = []
    for length in range(size, 0, -1):
        rest = int(counts[length])
        while rest:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(size, -(-rest // (size // length)), ())
                continue
            room = rooms[at]
            many, content = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, rest)
            filled = min(many, rest // each)
            rest -= filled * each
            if many > filled:
                put(room, many - filled, content)
            new = (filled, (*content, (length, each)))
            if room - each * length:
                put(room - each * length, *new)
            else:
                done.append(new)
    return done + [(many, content) for room in rooms for many, content in open_[room] if content]


def plan(counts: np.ndarray, size: int) -> list[Kind]:
    """The kinds of sequences that hold counts[length] pieces of each length, lengths up to size."""
    rest = np.asarray(counts, np.int64).copy()
    found = enumerate_patterns(np.flatnonzero(rest), size)
    kinds: list[Kind] = []
    if len(found):
        x = fit(found, rest.astype(float))
        for i in np.argsort(-x, kind="stable")[: np.count_nonzero(x)].tolist():
            times = [(v, int(n)) for v, n in zip(*np.unique(found[i][found[i] > 0], return_counts=True), strict=True)]
            many = min(round(x[i]), *(int(rest[v]) // n for v, n in times))
            if many:
                for v, n in times:
                    rest[v] -= many * n
                kinds.append((many, tuple((int(v), n) for v, n in reversed(times))))
    return kinds + best_fit(rest, size)


# -- places
@dataclass
class Places:
    """Ranges of ranks: the pieces of a length with ranks from `first` on lie in sequences from `sequence` on, `each` in one, from `offset` on."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, kinds: list[Kind]) -> Places:
        rows, used, sequence = [], {}, 0
        for many, content in kinds:
            offset = 0
            for length, each in content:
                rows.append((length, used.get(length, 0), sequence, each, offset))
                used[length] = used.get(length, 0) + many * each
                offset += length * each
            sequence += many
        rows.sort()
        length, first, sequence_, each, offset = np.array(rows, np.int64).reshape(-1, 5).T
        return cls(_place_key(length, first), first, sequence_, each, offset)

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, _place_key(length, rank), "right") - 1
        n = rank - self.first[i]
        return self.sequence[i] + n // self.each[i], self.offset[i] + n % self.each[i] * length


def _place_key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 47) + rank  # lengths below 65536, ranks below 10^14


def pack(found: DataFrame, size: int = 1024, bucket: int = 500) -> DataFrame:
    """Pieces (with doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    bucket: about how many pieces of one length are ranked together.
    """
    spark = found.sparkSession
    if not 0 < size < 1 << 16:
        raise ValueError("sequences have 1 to 65535 tokens")
    found = cut(found, "pieces")
    histogram = found.groupBy("length").count().collect()  # a row for each length up to size
    counts = np.zeros(size + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    places = Places.of(plan(counts, size))
    dealt = spark.createDataFrame([(int(v), int(-(-counts[v] // bucket))) for v in np.flatnonzero(counts)], "length long, buckets long")
    keyed = found.join(F.broadcast(dealt), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("buckets"))).drop("buckets")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ready = ranked.join(before, ["length", "bucket"]).select(*found.columns, (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.at(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ready.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences of packed pieces with ids: sequence_id, ids, and the doc_id and length of each piece in them, in order."""
    placed = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))  # no more than a sequence has tokens
    sequence = packed.groupBy("sequence_id").agg(placed.alias("x"))
    return sequence.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.length").alias("lengths"))
