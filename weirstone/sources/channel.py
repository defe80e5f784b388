"""In-process channels: rows handed over by the program itself, in batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weirstone.errors import EngineError, SchemaError


class ChannelSource:
    """Batches that were sent, until the sender closes."""

    def __init__(self, schema: T.StructType, capacity: int = 64):
        self.schema, self.capacity = schema, capacity
        self.waiting: deque[list[tuple]] = deque()
        self.closed = False

    def send(self, rows: Iterable[tuple]) -> bool:
        """False if the channel is full."""
        if self.closed:
            raise EngineError("the channel is closed")
        if len(self.waiting) >= self.capacity:
            return False
        batch = [tuple(r) for r in rows]
        if any(len(r) != len(self.schema) for r in batch):
            raise SchemaError("a row has another number of fields than the schema")
        self.waiting.append(batch)
        return True

    def close(self) -> None:
        self.closed = True

    def batches(self, spark: SparkSession) -> Iterator[DataFrame]:
        while self.waiting:
            yield spark.createDataFrame(self.waiting.popleft(), self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """All batches that are waiting as one."""
        rows = [r for batch in self.waiting for r in batch]
        self.waiting.clear()
        return spark.createDataFrame(rows, self.schema)


class ChannelSink:
    """Keeps what is written as frames, for the program to take."""

    def __init__(self) -> None:
        self.pending: deque[DataFrame] = deque()

    def write(self, df: DataFrame) -> None:
        self.pending.append(df)

    def pending_batches(self) -> int:
        return len(self.pending)

    def take(self) -> DataFrame | None:
        return self.pending.popleft() if self.pending else None
