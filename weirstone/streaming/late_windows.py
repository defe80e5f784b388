"""Window operators over a stream, one run for each micro-batch, with durable watermark and fired windows.

State lies in a shared folder in versions numbered by the batch: batch b reads what batches below b wrote and writes its own version,
which a replay of b overwrites, so a replayed batch gives the same results. Only newly fired windows are written each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weirstone.errors import ConfigurationError
from weirstone.functions.aggregates import Reduce
from weirstone.functions.key_hash import key_hash
from weirstone.operators.lateness import WindowResults, beyond_lateness
from weirstone.operators.windows import ID, MS, Session, Sliding, Windowed, assigned, processed, session_marks


@dataclass
class LateWindows:
    """Runs a window operator batch by batch. folder is one that driver and executors share."""

    op: Windowed
    folder: str
    #: Forget windows that ended before watermark - lateness - span; they fire on time if rows of theirs come all the same.
    evict: bool = False

    def _versions(self, spark: SparkSession, name: str, batch: int, schema: T.StructType) -> DataFrame:
        """Rows of the versions below a batch."""
        empty = spark.createDataFrame([], schema)
        try:
            df = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty
        return df.where(F.col("batch") < batch).drop("batch")

    def _put(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def run(self, df: DataFrame, batch: int) -> WindowResults:
        """One run: results on time and late, and the side output, as tables in the folder."""
        spark, op = df.sparkSession, self.op
        rows = op.prepared(df)
        marks = self._versions(spark, "watermark", batch, T.StructType([T.StructField("ms", T.LongType())]))
        before = marks.agg(F.max("ms")).first()[0]
        top = rows.agg(F.max(MS)).first()[0]
        after = max((x for x in (before, top) if x is not None), default=None)
        if op.allowed_lateness_ms is not None:
            gone = beyond_lateness(F.col(MS), F.lit(before).cast("bigint"), op.allowed_lateness_ms)
            kept, dropped = rows.where(~gone), rows.where(gone)
        else:
            kept, dropped = rows, rows.where(F.lit(False))
        key_fields = [T.StructField(k, df.schema[k].dataType) for k in op.keyed_by]
        fired = self._versions(spark, "fired", batch, T.StructType([*key_fields, T.StructField(ID, T.LongType())]))
        if self.evict and after is not None and not isinstance(op.window, Session):
            fired = fired.where(op.window.start(F.col(ID)) + op.window.span_ms >= after - (op.allowed_lateness_ms or 0) - op.window.span_ms)
        old = fired.distinct().select(F.col(ID).alias("_w"), *(F.col(k).alias(f"_k_{k}") for k in op.keyed_by), F.lit(True).alias("_seen"))
        same = F.col(ID) == F.col("_w")
        for k in op.keyed_by:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        extra = ["_w", "_seen", *(f"_k_{k}" for k in op.keyed_by)]
        if isinstance(op.function, Reduce):
            found = op.reduced(kept)
            flagged = found.join(old, same, "left").withColumn("_late", F.coalesce("_seen", F.lit(False))).drop(*extra)
            own = [c for c in flagged.columns if c not in (*op.keyed_by, ID, "_late")]
            out = flagged.select(ID, key_hash([F.col(k) for k in op.keyed_by]).alias("key_hash"), *op.keyed_by, *own, "_late")
            on_time, late = out.where(~F.col("_late")).drop("_late"), out.where("_late").drop("_late")
            firings = found.select(*op.keyed_by, ID)
        else:
            whole = session_marks(kept, op.window, op.keyed_by) if isinstance(op.window, Session) else assigned(kept, op.window)
            flagged = whole.join(old, same, "left").withColumn("_late", F.coalesce("_seen", F.lit(False))).drop(*extra).withColumn("_watermark", F.lit(after).cast("bigint"))
            on_time, late = processed(op, flagged.where(~F.col("_late")), []), processed(op, flagged.where("_late"), [])
            firings = whole.select(*op.keyed_by, ID).distinct()
        for name, part in (("on_time", on_time), ("late", late), ("side_output", dropped.drop(MS))):
            self._put(part, name, batch)
        self._put(firings, "fired", batch)
        self._put(spark.createDataFrame([(after,)], "ms bigint"), "watermark", batch)
        return WindowResults(*(self.results(spark, n, batch) for n in ("on_time", "late", "side_output")))

    def results(self, spark: SparkSession, name: str, batch: int | None = None) -> DataFrame:
        """Result rows of one batch, or of all with the column batch."""
        df = spark.read.parquet(f"{self.folder}/{name}")
        return df if batch is None else df.where(F.col("batch") == batch).drop("batch")

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Run over a stream; trigger as in DataStreamWriter.trigger."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: self.run(df, batch) and None)
        return (writer.trigger(**trigger) if trigger else writer).start()


def native(op: Windowed, stream: DataFrame, time_column: str) -> DataFrame:
    """The same windows by Spark's own stateful aggregation: one merged row for each window when the watermark passes it.

    Another contract than LateWindows: no late firings, no side output, and late means that the whole window is past.
    time_column is a timestamp.
    """
    if not isinstance(op.function, Reduce):
        raise ConfigurationError("process functions have no native form")
    delay = f"{op.allowed_lateness_ms or 0} milliseconds"
    marked = stream.withWatermark(time_column, delay)
    if isinstance(op.window, Session):
        by = F.session_window(time_column, f"{op.window.gap_ms} milliseconds")
    elif isinstance(op.window, Sliding):
        by = F.window(time_column, f"{op.window.size_ms} milliseconds", f"{op.window.slide_ms} milliseconds", f"{op.window.offset_ms % op.window.slide_ms} milliseconds")
    else:
        by = F.window(time_column, f"{op.window.size_ms} milliseconds", f"{op.window.size_ms} milliseconds", f"{op.window.offset_ms % op.window.size_ms} milliseconds")
    return marked.groupBy(by.alias("span"), *op.keyed_by).agg(op.function.column())
