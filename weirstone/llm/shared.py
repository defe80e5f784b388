"""What the operators of this subpackage share: the shared work folder, byte columns, batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch sent to Python where whole texts travel: a few MB.
TEXT_BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: Input bytes that one task of a shuffle by key is meant to take.
TASK_BYTES = 32 << 20


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the one that driver and executors share.

    Only where that setting is absent in local mode (tests) a temporary folder stands in for it; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: executors and driver need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="weirstone-")
    return f"{_scope[-1] if _scope else base.rstrip('/')}/weirstone-{uuid.uuid4().hex}"


_scope: list[str] = []


@contextlib.contextmanager
def scoped(folder: str) -> Iterator[None]:
    """Within it new work folders lie below this one, so that they can be removed together."""
    _scope.append(folder)
    try:
        yield
    finally:
        _scope.pop()


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of whatever file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, rows: int = 65_536) -> DataFrame:
    """A table of the shared folder marked for broadcast if it is counted to have so many rows at most, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def spool(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there."""
    path = work_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts must stay small whatever the session's row count is; long rows end a batch by their bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(col: str = "text") -> Column:
    """A text column where null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as the struct _doc, so that none of them clashes with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_doc")


def doc_schema(rows: DataFrame, rest: str, name: str = "_doc") -> T.StructType:
    """The schema of a result that hands _doc (or another column) on, with these columns after it; names in it may be anything."""
    return T.StructType([T.StructField(name, rows.schema[name].dataType), *T.StructType.fromDDL(rest).fields])


def unpacked(df: DataFrame) -> list[Column]:
    """The table's columns out of _doc."""
    return [F.col("_doc").getField(c).alias(c) for c in df.columns]


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(table: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of so many rows at most."""
    for at in range(0, table.num_rows, rows):
        yield table.slice(at, rows)


def byte_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without copying, and the n + 1 offsets of its rows.

    A null row has no bytes if the producer wrote none for it, which Spark's does.
    """
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the length as the last item."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).astype(np.int64)
