"""Vector codes by product quantisation, with codebooks from Lloyd's rounds under Hamerly's bounds.

Vectors are cut into parts; each part position has a codebook, which starts from
the first vectors and moves in rounds: every part goes to its nearest entry, then
each entry to the floor of its parts' mean. All of it is integer arithmetic, so
results don't depend on the order of rows.

Between rounds a row keeps, for each part, the entry, an upper bound on the
distance to it and a lower bound on that to the second nearest. As entries move,
the upper bound grows by the way of its own, the lower one falls by the longest
way of the others. A part whose upper bound lies strictly below the lower one, or
below half the way from its entry to the next one, stays where it is without any
distance; one that fails has its own distance computed, and only if that fails
too are all entries compared, in integers, the lower index winning ties. Bounds
are rounded outwards. State is written as a table each round, the round before
being dropped; entries are sums by entry, some thousands of numbers.

Rows: vectors that are null or hold null or non-finite components are dropped,
and those of another length than most (`vectors.usable`); a length that is no
multiple of the parts is filled up with zeros; fewer ids than entries make smaller
codebooks; of rows that repeat an id the smallest vector may be an entry, once;
rows without an id are coded but are no first entries; equal vectors have equal
codes; an empty table gives no rows. Components beyond 2^21 / scale or so, whose
distances are no exact doubles, raise OverflowError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.vectors import lists, matrix
from quadrille.plans.lineage import cut, discard

_UP, _DOWN = 1 + 1e-14, 1 - 1e-14


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries: integers, exact as doubles."""
    return (x**2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * (x @ book.T)


class Books:
    """The codebooks of one round, and how they moved since the last one."""

    def __init__(self, books: np.ndarray, before: np.ndarray | None = None):
        self.books = books.astype(float)
        parts, k, _ = books.shape
        moved = np.sqrt(((self.books - before.astype(float)) ** 2).sum(2)) * _UP if before is not None else np.zeros((parts, k))
        self.moved = moved
        # The longest way of any other entry.
        first = moved.argmax(1)
        rest = moved.copy()
        rest[np.arange(parts), first] = 0
        self.others = np.where(np.arange(k)[None] == first[:, None], rest.max(1)[:, None], moved.max(1)[:, None])
        self.half = np.full((parts, k), np.inf)
        for p in range(parts):
            apart = _distances(self.books[p], self.books[p])
            apart[np.diag_indices(k)] = np.inf
            self.half[p] = np.sqrt(apart.min(1)) / 2 * _DOWN

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
        """Moves code, upper and lower (rows x parts) on; the squared distances of every part to its entry, and how many parts were compared with all entries."""
        rows, parts, width = len(x), *self.books.shape[::2]
        error, scans = np.zeros((rows, parts), np.int64), 0
        for p in range(parts):
            part, book = x[:, p * width : (p + 1) * width].astype(float), self.books[p]
            c, up, low = code[:, p], upper[:, p], lower[:, p]
            up[:] = (up + self.moved[p][c]) * _UP
            low[:] = (low - self.others[p][c]) * np.where(low > self.others[p][c], _DOWN, _UP)
            own = ((part - book[c]) ** 2).sum(1)
            open_ = np.flatnonzero(up >= np.maximum(low, self.half[p][c]))
            up[open_] = np.sqrt(own[open_]) * _UP
            open_ = open_[up[open_] >= np.maximum(low[open_], self.half[p][c[open_]])]
            if len(open_):
                scans += len(open_)
                away = _distances(part[open_], book)
                best = away.argmin(1)  # the first of several
                at = np.arange(len(open_))
                nearest = away[at, best]
                away[at, best] = np.inf
                c[open_], own[open_] = best, nearest
                up[open_], low[open_] = np.sqrt(nearest) * _UP, np.sqrt(away.min(1)) * _DOWN
            error[:, p] = own
        return error, scans


def _checked(vectors: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """Components as integers, with zeros up to a multiple of the parts."""
    x = np.floor(vectors * scale)
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))
    if x.size and 4 * (x.shape[1] // parts) * float(np.abs(x).max()) ** 2 >= 2**53:
        raise OverflowError("components are too large for exact distances")
    return x.astype(np.int64)


def first_books(vectors: DataFrame, key: str, column: str, entries: int, parts: int, scale: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids."""
    least = vectors.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(column).alias(column)).orderBy(key).limit(entries)
    rows = [r[column] for r in least.select(key, column).orderBy(key).collect()]  # as many as a codebook has entries
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    x = _checked(np.array(rows), scale, parts)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


_STATE = "x array<int>, code array<int>, upper array<double>, lower array<double>, error long, scans long"


def _round(table: DataFrame, books: Books, keep: tuple[str, ...], fresh: tuple[str, int] | None = None) -> DataFrame:
    """One assignment of every row; fresh: (column, scale) of vectors that have no state yet."""
    parts = len(books.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = batch.num_rows, len(keep)
            if not n:
                continue
            if fresh:
                x = _checked(matrix(batch.column(own)), fresh[1], parts)
                code, upper, lower = np.zeros((n, parts), np.int32), np.full((n, parts), np.inf), np.zeros((n, parts))
            else:
                x, code, upper, lower = (matrix(batch.column(own + i)) for i in range(4))
                code, upper, lower = code.copy(), upper.copy(), lower.copy()
            error, scans = books.assign(x, code, upper, lower)
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], lists(x.astype(np.int32)), lists(code), lists(upper), lists(lower), pa.array(error.sum(1)), pa.array(np.r_[scans, np.zeros(n - 1, np.int64)])], names)

    names = [*keep, "x", "code", "upper", "lower", "error", "scans"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in table.select(*keep).schema) if keep else ""
    return table.select(*keep, *([fresh[0]] if fresh else ["x", "code", "upper", "lower"])).mapInArrow(run, fields + _STATE)


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry at the floor of its parts' mean, those without parts where they were."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, at = matrix(batch.column(0)).astype(np.int64), matrix(batch.column(1)) + np.arange(parts) * k
                for p in range(parts):
                    n += np.bincount(at[:, p], minlength=parts * k)
                    order = np.argsort(at[:, p], kind="stable")
                    own = at[order, p]
                    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    sums[own[begin]] += np.add.reduceat(x[order, p * width : (p + 1) * width], begin)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), lists(sums[some])], ["at", "n", "sums"])

    partial = state.select("x", "code").mapInArrow(run, "at long, n long, sums array<long>")
    whole = partial.groupBy("at").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums"))
    out = books.reshape(parts * k, width).copy()
    for r in whole.collect():  # a row for each entry
        out[r["at"]] = [s // r["n"] for s in r["sums"]]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "vector", keep: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The rows with code and error, the codebooks, and how many parts each round compared with all entries.

    Of the rows come the columns to keep, code (array<int>, an entry for each part)
    and error (squared distances to the entries, summed over the parts).
    """
    books = first_books(vectors, key, column, entries, parts, scale)
    if not books.shape[1]:  # no ids
        return vectors.where("false").select(*keep, F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), books, []
    state = cut(_round(vectors, Books(books), keep, (column, scale)), "codes")
    scans = []
    for _ in range(rounds):
        scans.append(state.agg(F.sum("scans")).first()[0])
        new = _moved(state, books)
        next_ = cut(_round(state, Books(new, books), keep), "codes")
        discard(state)
        state, books = next_, new
    scans.append(state.agg(F.sum("scans")).first()[0])
    return state.select(*keep, "code", "error"), books, scans


def code_text(code: str = "code"):
    """Two lower-case hexadecimal digits for each part's entry."""
    return F.array_join(F.transform(code, lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")


def books_sha256(books: np.ndarray) -> str:
    """The hash of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray, scale: int = 1024, out: str = "vector") -> DataFrame:
    """The rows with the vector that a code stands for: its entries one after the other, in the scale of the vectors."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = matrix(batch.column(batch.schema.get_field_index("code")))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(np.concatenate([books[p][code[:, p]] for p in range(parts)], axis=1) / scale)], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{fields}, `{out}` array<double>")
