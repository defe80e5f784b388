"""Files in and out: Parquet, CSV and line-delimited JSON. Projections and filters reach the scans through Catalyst."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import SchemaError
from weirstone.operators.casting import cast_rows

#: Records of line-delimited JSON that a schema is inferred from unless told otherwise.
INFER_RECORDS = 1024


@dataclass(frozen=True)
class ParquetSource:
    path: str
    schema: T.StructType | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(self.path)
        return df if self.schema is None else cast_rows(df, self.schema, safe=False)

    def stream(self, spark: SparkSession, files_per_trigger: int | None = None) -> DataFrame:
        schema = self.schema or spark.read.parquet(self.path).schema
        return _limited(spark.readStream.schema(schema), files_per_trigger).parquet(self.path)


@dataclass(frozen=True)
class CsvSource:
    path: str
    schema: T.StructType
    header: bool = True

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).option("header", self.header).option("mode", "FAILFAST").csv(self.path)

    def stream(self, spark: SparkSession, files_per_trigger: int | None = None) -> DataFrame:
        return _limited(spark.readStream.schema(self.schema).option("header", self.header).option("mode", "FAILFAST"), files_per_trigger).csv(self.path)


@dataclass(frozen=True)
class JsonSource:
    """Without a schema, the first infer_records records give it; later fields that they lack are left out."""

    path: str
    schema: T.StructType | None = None
    infer_records: int = INFER_RECORDS

    def inferred(self, spark: SparkSession) -> T.StructType:
        head = [r.value for r in spark.read.text(self.path).where(F.length(F.trim("value")) > 0).limit(self.infer_records).collect()]
        if not head:
            raise SchemaError(f"{self.path} has no record to infer a schema from")
        return inferred_from(spark, head)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema or self.inferred(spark)).option("mode", "FAILFAST").json(self.path)

    def stream(self, spark: SparkSession, files_per_trigger: int | None = None) -> DataFrame:
        return _limited(spark.readStream.schema(self.schema or self.inferred(spark)).option("mode", "FAILFAST"), files_per_trigger).json(self.path)


def inferred_from(spark: SparkSession, records: list[str]) -> T.StructType:
    """The schema of a few JSON records; only the reader infers one, and it takes texts as an RDD."""
    return spark.read.json(spark.sparkContext.parallelize(records, 1)).schema


def json_rows(spark: SparkSession, data: bytes, schema: T.StructType | None = None, infer_records: int = INFER_RECORDS) -> DataFrame:
    """Rows of line-delimited JSON held in memory."""
    lines = [x for x in data.decode().splitlines() if x.strip()]
    if schema is None:
        if not lines:
            raise SchemaError("no record to infer a schema from")
        schema = inferred_from(spark, list(islice(lines, infer_records)))
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def _limited(reader, files: int | None):
    return reader if files is None else reader.option("maxFilesPerTrigger", files)


@dataclass(frozen=True)
class FileSink:
    """A folder of part files in a format; mode overwrite unless told otherwise."""

    path: str
    format: str = "parquet"
    header: bool = True
    mode: str = "overwrite"

    def write(self, df: DataFrame) -> None:
        writer = df.write.mode(self.mode)
        if self.format == "parquet":
            writer.option("compression", "snappy").parquet(self.path)
        elif self.format == "csv":
            writer.option("header", self.header).csv(self.path)
        else:
            writer.json(self.path)


@dataclass(frozen=True)
class CastingSource:
    """Another source's rows brought to a schema."""

    source: ParquetSource | CsvSource | JsonSource
    schema: T.StructType
    safe: bool = True

    def read(self, spark: SparkSession) -> DataFrame:
        return cast_rows(self.source.read(spark), self.schema, self.safe)
