"""Helpers for columns of embedding vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, hold only finite numbers and are not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that extreme vectors neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in doubles; equal pairs of rows give equal numbers."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def principal_axes(frame: DataFrame, vector: str, dims: int) -> np.ndarray:
    """Axes (columns, by falling variance) of the unit vectors of all rows of ``frame``, which have ``dims`` components.

    Each task sums its outer products; dims * dims sums come to the driver, whatever the number of rows.
    """

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            u = unit(matrix(batch.column(0))) if batch.num_rows else np.zeros((0, dims))
            total += u.T @ u
        cells = [pa.array(np.repeat(np.arange(dims, dtype=np.int32), dims)), pa.array(np.tile(np.arange(dims, dtype=np.int32), dims)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", "x"])

    sums = frame.select(vector).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    moments = np.zeros((dims, dims))
    for row in sums.toLocalIterator():
        moments[row["i"], row["j"]] = row["x"]
    values, axes = np.linalg.eigh((moments + moments.T) / 2)
    return axes[:, np.argsort(-values)]
