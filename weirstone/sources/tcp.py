"""Rows over TCP: frames of a big-endian u32 length and an Arrow IPC stream with one batch.

The driver listens. Each accepted frame becomes a batch with a number; a micro-batch is a range of numbers, and its frames are kept
until Spark commits the range, so a retried task gets them again. An empty frame is skipped. A frame that is too long, cut off, unreadable
or of another schema closes its own connection only. The source never ends.

    register(spark)
    spark.readStream.format("weirstone_tcp").schema(...).option("bind", "127.0.0.1:0").load()
"""

from __future__ import annotations

import io
import socket
import struct
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Most waiting frames, and most bytes of one.
BUFFER, MOST_BYTES = 64, 8 << 20
FORMAT = "weirstone_tcp"


def pack(batch: pa.RecordBatch) -> bytes:
    """A frame of one batch, for senders."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    data = out.getvalue()
    return struct.pack(">I", len(data)) + data


def _exactly(conn: socket.socket, n: int) -> bytes | None:
    parts = []
    while n:
        part = conn.recv(min(n, 1 << 16))
        if not part:
            return None
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


class Listener:
    """Accepts connections and keeps their batches in order, BUFFER at most; senders wait while it is full."""

    def __init__(self, host: str, port: int, schema: pa.Schema, buffer: int = BUFFER, most_bytes: int = MOST_BYTES):
        self.schema, self.most_bytes = schema, most_bytes
        self.room = threading.Semaphore(buffer)
        self.lock = threading.Lock()
        self.frames: dict[int, pa.RecordBatch] = {}
        self.first = self.next = 0
        self.server = socket.create_server((host, port))
        self.address = self.server.getsockname()
        threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            try:
                conn, _ = self.server.accept()
            except OSError:
                return
            threading.Thread(target=self._serve, args=(conn,), daemon=True).start()

    def _serve(self, conn: socket.socket) -> None:
        with conn:
            while (head := _exactly(conn, 4)) is not None:
                n = struct.unpack(">I", head)[0]
                if not n:
                    continue
                if n > self.most_bytes or (data := _exactly(conn, n)) is None:
                    return
                try:
                    batches = list(pa.ipc.open_stream(data))
                except (pa.ArrowInvalid, OSError):
                    return
                if len(batches) != 1 or not batches[0].schema.equals(self.schema, check_metadata=False):
                    return
                self.room.acquire()
                with self.lock:
                    self.frames[self.next] = batches[0]
                    self.next += 1

    def between(self, start: int, end: int) -> list[pa.RecordBatch]:
        with self.lock:
            return [self.frames[k] for k in range(start, end)]

    def forget(self, end: int) -> None:
        with self.lock:
            while self.first < end:
                self.frames.pop(self.first)
                self.first += 1
                self.room.release()

    def close(self) -> None:
        self.server.close()


#: Listeners of this process by the number of their reader: readers are pickled, sockets can't be.
_listeners: dict[str, Listener] = {}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options, self.number = schema, options, uuid.uuid4().hex

    @property
    def listener(self) -> Listener:
        """Started at the first call in the process that runs the source."""
        if self.number not in _listeners:
            host, _, port = self.options.get("bind", "127.0.0.1:0").rpartition(":")
            own = Listener(host or "127.0.0.1", int(port), to_arrow_schema(self.fields), int(self.options.get("buffer", BUFFER)), int(self.options.get("max_frame_bytes", MOST_BYTES)))
            _listeners[self.number] = own
            if path := self.options.get("address_file"):  # tells a caller which port was taken
                with open(path, "w") as f:
                    f.write(f"{own.address[0]}:{own.address[1]}")
        return _listeners[self.number]

    def initialOffset(self) -> dict:
        assert self.listener
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = self.listener.next
        return self._rows(start["frame"], end), {"frame": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["frame"], end["frame"])

    def _rows(self, start: int, end: int) -> Iterator[tuple]:
        """A list's iterator, as Spark copies it; a micro-batch holds the frames of a full buffer at most."""
        return iter([row for batch in self.listener.between(start, end) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    def commit(self, end: dict) -> None:
        self.listener.forget(end["frame"])


class TcpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("give a schema")

    def simpleStreamReader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TcpSource)


__all__ = ["BUFFER", "FORMAT", "Listener", "MOST_BYTES", "TcpSource", "pack", "register"]
