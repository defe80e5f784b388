"""Row ranges, and functions that run on slices of rows whose results are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame


def row_range(df: DataFrame, order: list[Column | str], offset: int, length: int) -> DataFrame:
    """Rows offset to offset + length (or the end) in this order, which should leave no ties."""
    return df.orderBy(*order).offset(offset).limit(length)


def run_slices(df: DataFrame, run_slice: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run_slice over each slice of the rows, wherever it lies, and merge over all slices' results as one table.

    A slice is an Arrow batch of a task, so how rows are cut is Spark's affair and merge has to give the same for any cut.
    Empty slices are not run; without rows merge gets an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield run_slice(batch)

    return merge(df.mapInArrow(run, schema))
