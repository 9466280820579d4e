"""What the operators on embeddings share: whole vectors, and their rows as integer matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """The vector is there and none of its components is NULL, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def whole_vectors(vectors: DataFrame, vector_col: str, **others: str) -> DataFrame:
    """``vector`` as doubles of every whole vector, and the ``others`` (new name = column), nothing else."""
    named = [F.col(column).alias(name) for name, column in others.items()]
    rows = vectors.select(*named, F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(whole("vector"))


def widest(rows: DataFrame) -> int:
    """The number of components of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def integers(column: pa.Array, width: int, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * component)`` of all rows, shorter vectors filled up with zeros.

    Raises if a value's size is above ``limit``, beyond which the sums that follow would not be exact.
    """
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    out = np.floor(scale * out)
    if len(out) and np.abs(out).max(initial=0) > limit:
        raise ValueError(f"a component is too large: {scale} times it is above {limit}")
    return out.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """All rows in batches of ``rows``, the last one smaller."""
    held, count = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, rows - count)
            held.append(piece)
            count += piece.num_rows
            at += piece.num_rows
            if count == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
