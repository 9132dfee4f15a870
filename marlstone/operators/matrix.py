"""Sums of matrices over partitions, and linear projections.

Each task turns its rows into one array of sums with NumPy and hands it on in
stretches of ``STRETCH`` numbers, which a grouping adds as vectors: one row per
task for small matrices, and large ones are added by several tasks.  What
reaches the driver is one d by d (or k by d by d) total, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STRETCH = 8192


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column as one matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def partition_sums(df: DataFrame, vec: str, extra: list[str], fn: Callable[..., np.ndarray]) -> np.ndarray:
    """Sum over all Arrow batches of ``fn(rows, *extra matrices)``, a flat array."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(*[rows_of(batch.column(c)) for c in (vec, *extra)])
                total = part if total is None else total + part
        if total is not None:
            pieces = [total[at:at + STRETCH] for at in range(0, total.size, STRETCH)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces))), pa.array(pieces, pa.list_(pa.float64()))], names=["i", "x"])

    parts = df.select(vec, *extra).mapInArrow(sums, "i long, x array<double>")
    rows = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("x")).alias("x")).collect()
    return np.concatenate([r.x.toArray() for r in sorted(rows, key=lambda r: r.i)]) if rows else np.zeros(0)


def map_rows(df: DataFrame, vec: str, name: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds ``fn`` of the row vectors (matrix in, matrix out) as an array column."""
    def apply(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], pa.list_(pa.float64()))
        out = fn(rows_of(batch))
        offsets = np.arange(0, out.size + 1, out.shape[1], dtype="int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return df.withColumn(name, F.arrow_udf(apply, "array<double>")(F.col(vec)))


def project(df: DataFrame, vec: str, basis: np.ndarray, name: str, centre: np.ndarray | None = None) -> DataFrame:
    """Row vectors times a small (d by k) basis, one matrix product per batch."""
    shift = np.zeros(basis.shape[0]) if centre is None else centre
    return map_rows(df, vec, name, lambda x: (x - shift) @ basis)


def moments(df: DataFrame, vec: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, vector of sums and matrix of cross products."""
    def fn(x: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))

    flat = partition_sums(df, vec, [], fn)
    return int(flat[0]), flat[1:size + 1], flat[size + 1:].reshape(size, size)
