"""Window state that adds up over micro-batches, kept in versions in a shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weirstone.operators import accumulator
from weirstone.operators.windows import MS, Windowed


@dataclass
class AccumulatorStore:
    """State rows by version: version b is what batches up to b add up to. A replayed batch starts from version b - 1 again."""

    op: Windowed
    folder: str
    mode: str = "merge"
    #: Versions that are kept besides the newest.
    keep: int = 2

    def load(self, spark: SparkSession, version: int) -> DataFrame | None:
        return spark.read.schema(accumulator.ACCUMULATOR.schema).parquet(f"{self.folder}/version={version}") if version >= 0 else None

    def add(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        top = self.op.prepared(df).agg(F.max(MS)).first()[0]
        new = accumulator.accumulated(self.op, df, top)
        prior = self.load(spark, batch - 1)
        state = new if prior is None else accumulator.merge(prior, new, self.mode)
        state.write.mode("overwrite").parquet(f"{self.folder}/version={batch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version={batch - 1 - self.keep}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add)
        return (writer.trigger(**trigger) if trigger else writer).start()
