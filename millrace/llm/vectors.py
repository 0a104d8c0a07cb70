"""Embeddings as vectors of integers, for sums and products without rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def integer_vectors(rows: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, x) of the rows whose vector isn't null and holds neither null nor non-finite entries; x = floor(scale * entry) as
    longs. A product beyond a long's range becomes the nearest long. Null ids and repeated rows stay; other columns go."""
    whole = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return rows.filter(F.coalesce(whole, F.lit(False))).select(F.col(key).alias("id"), x.alias("x"))


def matrices(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) for each length of vector in an Arrow batch."""
    lists = batch.column(column)
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat.reshape(-1, d) if len(rows) == len(sizes) and d else flat[starts[rows][:, None] + np.arange(d)]
