"""Vectors of Arrow batches as matrices, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a vector table that are worked on at once.
ROWS = 8192


def finite(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The commonest number of components, the larger of equals; 0 without rows."""
    sizes = vectors.groupBy(F.size(column).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose values have ``width`` entries each, none of them null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def totals(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], size: int, kind=np.float64) -> np.ndarray:
    """Sum over all rows of what ``add`` makes of each batch. A task sends one
    value per place and Spark adds them, so the driver gets ``size`` values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for batch in batches:
            if batch.num_rows:
                total += add(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "part"])

    name = "long" if kind is np.int64 else "double"
    parts = rows.mapInArrow(run, f"place long, part {name}")
    out = np.zeros(size, kind)
    for row in parts.groupBy("place").agg(F.sum("part").alias("value")).collect():
        out[row.place] = row.value
    return out
