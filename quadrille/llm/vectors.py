"""Rows with usable vectors, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, column: str, out: str = "vector", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep and the vector as array<double>, of rows whose vector has neither null nor non-finite entries.

    Vectors have one length: that of most of them, the longest of those if several
    are as common; rows of another length are left out, as are empty vectors.
    """
    kept = df.select(*keep, F.col(column).cast("array<double>").alias(out))
    kept = kept.where(F.size(out) > 0).where(F.forall(out, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    most = kept.groupBy(F.size(out).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return kept.where(F.size(out) == (most["length"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """A list column of a matrix's rows."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(rows).reshape(-1)))
