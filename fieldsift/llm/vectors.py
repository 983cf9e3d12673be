"""Vectors as whole numbers: which rows take part, and their matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsift.llm.shared import col

# Scaled components of a larger magnitude are set to it.
LARGEST = 1 << 26


def whole_vectors(rows: DataFrame, vector: str, scale: int, **columns: Column) -> DataFrame:
    """``columns`` and ``v``: floor(scale * x) of each component.

    Vectors that are null or hold null or non-finite components take no part.
    """
    exact = col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    limit = F.lit(float(LARGEST))
    number = lambda x: F.floor(F.greatest(F.least(x * scale, limit), -limit)).cast("int")
    taken = rows.select(*(c.alias(n) for n, c in columns.items()), exact.alias("v"))
    return taken.filter(F.col("v").isNotNull() & ~bad).withColumn("v", F.transform("v", number))


def longest(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors, and components of the longest."""
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    return facts["n"], facts["size"] or 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(column) * width:
        return values.reshape(len(column), width).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
