"""From type names of configuration files to sources and sinks. A program adds its own kinds with register_source and register_sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weirstone.errors import ConfigurationError
from weirstone.sources.channel import ChannelSink, ChannelSource
from weirstone.sources.files import CsvSource, FileSink, JsonSource, ParquetSource
from weirstone.types import parse_schema

Options = Mapping[str, Any]


@dataclass(frozen=True)
class TcpSpec:
    bind: str
    schema: Any
    buffer: int
    max_frame_bytes: int

    def stream(self, spark: SparkSession, files_per_trigger: int | None = None) -> DataFrame:
        from weirstone.sources import tcp

        tcp.register(spark)
        return spark.readStream.format(tcp.FORMAT).schema(self.schema).option("bind", self.bind).option("buffer", str(self.buffer)).option("max_frame_bytes", str(self.max_frame_bytes)).load()


def _path(o: Options) -> str:
    if not o.get("path"):
        raise ConfigurationError("a path is needed")
    return str(o["path"])


def _schema(o: Options, needed: bool = True) -> Any:
    fields = o.get("schema") or o.get("fields")
    if isinstance(fields, Mapping):
        fields = fields.get("fields")
    if not fields:
        if needed:
            raise ConfigurationError("a schema is needed")
        return None
    return parse_schema(fields)


class Registry:
    def __init__(self) -> None:
        from weirstone.sources.tcp import BUFFER, MOST_BYTES

        self.sources: dict[str, Callable[[Options], Any]] = {
            "ParquetSource": lambda o: ParquetSource(_path(o), _schema(o, False)),
            "CsvSource": lambda o: CsvSource(_path(o), _schema(o), bool(o.get("has_header", True))),
            "JsonSource": lambda o: JsonSource(_path(o), _schema(o, False), int(o.get("infer_max_records", 1024))),
            "ChannelSource": lambda o: ChannelSource(_schema(o), int(o.get("capacity", 64))),
            "tcp": lambda o: TcpSpec(str(o.get("bind", "127.0.0.1:0")), _schema(o), int(o.get("buffer", BUFFER)), int(o.get("max_frame_bytes", MOST_BYTES))),
        }
        self.sinks: dict[str, Callable[[Options], Any]] = {
            "ParquetSink": lambda o: FileSink(_path(o), "parquet"),
            "CsvSink": lambda o: FileSink(_path(o), "csv", bool(o.get("has_header", True))),
            "JsonSink": lambda o: FileSink(_path(o), "json"),
            "ChannelSink": lambda o: ChannelSink(),
        }

    def register_source(self, kind: str, make: Callable[[Options], Any]) -> None:
        self._new(self.sources, kind, make)

    def register_sink(self, kind: str, make: Callable[[Options], Any]) -> None:
        self._new(self.sinks, kind, make)

    @staticmethod
    def _new(table: dict, kind: str, make: Callable) -> None:
        if kind in table:
            raise ConfigurationError(f"there is a kind {kind!r} already")
        table[kind] = make

    def source(self, kind: str, options: Options) -> Any:
        return self._make(self.sources, "source", kind, options)

    def sink(self, kind: str, options: Options) -> Any:
        return self._make(self.sinks, "sink", kind, options)

    @staticmethod
    def _make(table: dict, what: str, kind: str, options: Options) -> Any:
        if kind not in table:
            raise ConfigurationError(f"no {what} of the kind {kind!r}; there are {', '.join(sorted(table))}")
        try:
            return table[kind](options)
        except ConfigurationError as e:
            raise ConfigurationError(f"{what} {kind}: {e}") from e
