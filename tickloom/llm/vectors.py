"""Vectors of many rows at once, as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 22  # bytes of a matrix that is handled at once


def usable(vector: str) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def usable_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is usable; the vector as the column ``vector`` of doubles, its length as ``dim``.

    A NaN is not below infinity only after this order: Spark sorts NaN above all numbers, so
    one comparison leaves out NaN and both infinities.
    """
    kept = df.where(usable(vector))
    return kept.withColumns({"vector": F.col(vector).cast("array<double>"), "dim": F.size(vector)})


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column whose lists all have ``dim`` entries, as rows of a matrix."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def row_blocks(batches: Iterator[pa.RecordBatch], width: int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of rows that take ``width`` doubles each."""
    rows = max(1, limit // (8 * max(1, width)))
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def decimals(values: list[int]) -> pa.Array:
    """Whole numbers of any size as decimal(38,0); null where they do not fit."""
    from decimal import Decimal

    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def whole(values: pa.Array) -> pa.Array:
    """64-bit whole numbers as decimal(38,0)."""
    return pc.cast(values, pa.decimal128(38, 0))
