"""SHA3-256 of a binary column, in Arrow batches: Spark has no such function of its own."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def sha3(df: DataFrame, field: str, alias: str = "sha3_256") -> DataFrame:
    """The rows with the digest of a field (null: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.names.index(field)).to_pylist()
            new = pa.array([None if x is None else hashlib.sha3_256(x).digest() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, alias])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{alias}` binary")
