"""SQL as a source: any query over registered tables, joins, set operations, ranking and all."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SqlSource:
    """A query; tables are registered as views before it runs. Values go in by name as parameters, not by pasting text."""

    query: str
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    parameters: Mapping[str, object] = field(default_factory=dict)
    estimated_rows: int | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(self.query, args=dict(self.parameters) or None)


    def read_each(self, spark: SparkSession, name: str, batches: Iterable[DataFrame]) -> Iterator[DataFrame]:
        """The query over each of several batches in turn, each registered under the name."""
        for df in batches:
            df.createOrReplaceTempView(name)
            yield self.read(spark)


def register_folder(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Parquet tables of a folder as views."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
