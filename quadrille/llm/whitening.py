"""Whitening by hierarchical merging of singular value decompositions.

A partition is summed up by its number of rows, their exact sum, and the singular
values and right vectors of its centred rows, all of them. Two summaries merge
without loss: the decomposition of their scaled vectors, one above the other, with
one row more for the distance of their means, is that of all their rows. Rows are
merged batch by batch in a partition, and partitions in groups of a few, level by
level, so a task holds some matrices of one vector length squared, and rounding
stays relative to the spread, however far from zero the mean lies.

Rows: vectors that are null or hold null or non-finite entries are dropped, and
those of another length than most (`vectors.usable`); equal vectors count as often
as they come; rows with a null id are rows like others. Components with no variance
beyond rounding are left out, since nothing can be divided by it; one row, or equal
rows alone, have none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.vectors import lists, matrix
from quadrille.plans.lineage import cut, discard


@dataclass
class Summary:
    """Rows by number, sum, and singular values with right vectors of the centred rows, smallest values too."""

    n: int
    total: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Summary:
        """Integer rows have an exact sum."""
        total = rows.sum(0)
        _, values, vectors = np.linalg.svd(_centred(rows, len(rows), total), full_matrices=False)
        return cls(len(rows), total, values, vectors)

    def merge(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = _ratio(self.total, self.n) - _ratio(other.total, other.n)
        if self.total.dtype.kind == "i":  # the means may be large beside their distance
            apart = np.array([(int(a) * other.n - int(b) * self.n) / (self.n * other.n) for a, b in zip(self.total, other.total, strict=True)])
        row = np.sqrt(self.n * other.n / n) * apart
        _, values, vectors = np.linalg.svd(np.concatenate([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, row[None]]), full_matrices=False)
        return Summary(n, self.total + other.total, values, vectors)

    def covariance(self) -> np.ndarray:
        return (self.vectors.T * self.values**2) @ self.vectors / self.n


def _ratio(total: np.ndarray, n: int) -> np.ndarray:
    return total / n


def _centred(rows: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """rows - total / n; integers are moved near zero before anything is rounded."""
    if rows.dtype.kind != "i":
        return rows - total / n
    near = total // n
    return (rows - near) - (total - n * near) / n


_SCHEMA = "part long, n long, total array<{}>, singular array<double>, vectors array<double>"


def _table(part: int, s: Summary) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([s.n]), pa.array([s.total]), pa.array([s.values]), pa.array([s.vectors.reshape(-1)])], ["part", "n", "total", "singular", "vectors"])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Summary]]:
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(5)), strict=True):
            part, n = row[0].as_py(), row[1].as_py()
            total, values, vectors = (x.values.to_numpy() for x in row[2:])
            yield part, Summary(n, total, values, vectors.reshape(len(values), len(total)))


def summarise(rows: DataFrame, column: str, fan: int = 8) -> Summary | None:
    """The summary of all vectors in a column of array<long> or array<double>, each of one length; None without rows.

    fan: how many summaries a task merges.
    """
    kind = "long" if rows.select(column).schema[0].dataType.elementType.simpleString() == "bigint" else "double"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            if batch.num_rows:
                new = Summary.of(matrix(batch.column(0)))
                known = known.merge(new) if known else new
        if known:
            yield _table(TaskContext.get().partitionId(), known)

    def next_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = None, 0
        for part, new in sorted(_merged(batches), key=lambda x: x[0]):
            known = known.merge(new) if known else new
        yield _table(part // fan, known)

    schema = _SCHEMA.format(kind)
    level = cut(rows.select(column).mapInArrow(first, schema), "svd")
    most = level.agg(F.max("part")).first()[0]
    if most is None:
        return None
    while most > 0:
        up = cut(level.groupBy(F.expr(f"part div {fan}")).applyInArrow(lambda table: pa.Table.from_batches(list(next_(table.to_batches()))), schema), "svd")
        discard(level)
        level, most = up, most // fan
    (_, found), = _merged(level.toArrow().to_batches())  # one row
    return found


@dataclass
class Whitening:
    """Unit eigenvectors of the covariance as rows, by falling eigenvalue, with n and the exact sums of the rows they were fitted to."""

    n: int
    total: np.ndarray
    vectors: np.ndarray
    eigen: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigen / self.trace


def fit(rows: DataFrame, column: str, most: int = 32, fan: int = 8) -> Whitening | None:
    """The first `most` components of all rows; None without rows."""
    s = summarise(rows, column, fan)
    if s is None:
        return None
    eigen = s.values**2 / s.n
    # Singular values are right to some units in the last place of the largest.
    some = s.values > s.values.max(initial=0.0) * max(s.vectors.shape) * 8 * np.finfo(float).eps
    k = min(most, int(some.sum()))
    return Whitening(s.n, s.total, s.vectors[:k], eigen[:k], float(eigen.sum()))


def whiten(rows: DataFrame, column: str, w: Whitening, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep, whitened (array<double>, a value for each component) and, for integer vectors, deviation.

    deviation: the sum over dimensions of (n x - total)^2, exact; one that is no
    64-bit number raises OverflowError.
    """
    exact = w.total.dtype.kind == "i"
    scaled = (w.vectors / np.sqrt(w.eigen)[:, None]).T
    near = w.total // w.n if exact else None
    rest = w.total - w.n * near if exact else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(len(keep)))
            out = [*batch.columns[: len(keep)], lists(_centred(x, w.n, w.total) @ scaled)]
            if exact:
                moved = x - near
                if (float(np.abs(moved).max(initial=0)) + 1) * w.n < 2**31 / np.sqrt(x.shape[1]):
                    sums = ((w.n * moved - rest) ** 2).sum(1)
                else:
                    sums = np.array([sum((w.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in moved.tolist()], object)
                    if max(sums, default=0) >= 2**63:
                        raise OverflowError("a deviation is no 64-bit number")
                out.append(pa.array(sums.tolist(), pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = [*keep, "whitened", *["deviation"] * exact]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema) if keep else ""
    return rows.select(*keep, column).mapInArrow(run, f"{fields}whitened array<double>" + ", deviation long" * exact)


def identity_error(whitened: DataFrame, fan: int = 8) -> float:
    """The largest entry of the covariance of whitened vectors minus the identity."""
    s = summarise(whitened, "whitened", fan)
    return float(np.abs(s.covariance() - np.eye(len(s.total))).max()) if s is not None and len(s.total) else 0.0
