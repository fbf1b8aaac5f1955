"""Columns of vectors as bytes, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_float_arrays(df: DataFrame, column: str) -> DataFrame:
    """The column as array<float> if it is one, else as array<double>."""
    return df if dict(df.dtypes)[column] == "array<float>" else df.withColumn(column, F.col(column).cast("array<double>"))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the non-null, non-empty lists of each length; null components are NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = pc.list_flatten(column.take(pa.array(rows)))
        yield rows, flat.to_numpy(zero_copy_only=False).reshape(len(rows), length)


def packed(rows: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Binary column of `rows` values; rows that no part names are null."""
    out = [None] * rows
    for at, matrix in parts:
        for i, row in zip(at.tolist(), np.ascontiguousarray(matrix)):
            out[i] = row.tobytes()
    return pa.array(out, pa.binary())


def unpacked(column, kind: str) -> np.ndarray:
    """Matrix of binary values of one length."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)
