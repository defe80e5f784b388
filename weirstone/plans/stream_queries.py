"""The same operators over Structured Streaming: files as micro-batches, results equal to the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions.aggregates import Reduce
from weirstone.operators.windows import Sliding, Tumbling, Windowed
from weirstone.plans.data_queries import scratch
from weirstone.plans.tables import DAY, HOUR, events_in_runs
from weirstone.plans.window_queries import FIRST, FNV, floor_id
from weirstone.plans.workloads import SETTLED, ledger, settlement_orders, settlement_pipeline
from weirstone.streaming import runner
from weirstone.streaming.accumulating import AccumulatorStore
from weirstone.streaming.late_windows import LateWindows

RUNS = 4


def as_stream(spark: SparkSession, rows: DataFrame, run: str, runs: int, folder: str) -> DataFrame:
    """A stream that brings the rows of run 0, 1, ... as one micro-batch each: a file for each run, written one after the other."""
    for k in range(runs):
        rows.where(F.col(run) == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _late(spark: SparkSession, folder: str) -> LateWindows:
    op = Windowed("ts", Tumbling(6 * HOUR), Reduce("value"), ["event_type"], allowed_lateness_ms=10 * DAY)
    base = scratch(spark)
    rows = events_in_runs(spark, folder, RUNS).withColumn("run", F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"), F.lit(3)).otherwise(F.pmod("event_id", F.lit(3))))
    late = LateWindows(op, f"{base}/state")
    late.start(as_stream(spark, rows, "run", RUNS, base), f"{base}/checkpoint", availableNow=True).awaitTermination()
    return late


LATE_PARTS = f"""
WITH e AS (SELECT *, {FIRST} AS ms, CAST(CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 3 ELSE event_id % 3 END AS BIGINT) AS batch FROM events WHERE ts IS NOT NULL),
r AS (SELECT batch, max(max(ms)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM e GROUP BY batch),
m AS (SELECT e.*, coalesce({10 * DAY} < wm AND ms < wm - {10 * DAY}, false) AS gone FROM e JOIN r USING (batch)),
g AS (SELECT batch, {floor_id("ms", 6 * HOUR)} AS window_id, event_type, round(sum(value), 4) AS sum_value FROM m WHERE NOT gone GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY window_id, event_type ORDER BY batch) > 1 AS late FROM g)
"""


def stream_late_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Firings of four micro-batches, on time and late, and the number of rows put aside by batch."""
    late = _late(spark, folder)
    value = F.round("sum_value", 4).alias("sum_value")
    firings = [late.results(spark, n).select(F.col("batch").cast("bigint").alias("batch"), F.lit(n).alias("kind"), "window_id", "event_type", value) for n in ("on_time", "late")]
    side = late.results(spark, "side_output").groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").cast("double").alias("sum_value"))
    none = F.lit(None)
    return firings[0].unionByName(firings[1]).unionByName(side.select("batch", F.lit("side_output").alias("kind"), none.cast("bigint").alias("window_id"), none.cast("string").alias("event_type"), "sum_value"))


def stream_accumulators(spark: SparkSession, folder: str) -> DataFrame:
    """Window state after three micro-batches."""
    base = scratch(spark)
    store = AccumulatorStore(Windowed("ts", Tumbling(DAY), Reduce("value"), ["event_type"], source="events"), f"{base}/state")
    store.start(as_stream(spark, events_in_runs(spark, folder, 3), "run", 3, base), f"{base}/checkpoint", availableNow=True).awaitTermination()
    return store.load(spark, 2).select("window_id", "key_hash", "count", F.round("sum_f64", 4).alias("sum_f64"), F.round("min_f64", 4).alias("min_f64"), F.round("max_f64", 4).alias("max_f64"))


def stream_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """State of overlapping windows after three micro-batches."""
    base = scratch(spark)
    store = AccumulatorStore(Windowed("ts", Sliding(2 * DAY, DAY), Reduce("value"), ["event_type"], source="events"), f"{base}/state")
    store.start(as_stream(spark, events_in_runs(spark, folder, 3), "run", 3, base), f"{base}/checkpoint", availableNow=True).awaitTermination()
    return store.load(spark, 2).select("window_id", "key_hash", "count", F.round("sum_f64", 4).alias("sum_f64"))


SLIDING = f"""
SELECT {floor_id(FIRST, DAY)} - j AS window_id, {FNV.format(key='event_type')} AS key_hash, count(value) AS count, round(sum(value), 4) AS sum_f64
FROM events, (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS t(j) WHERE ts IS NOT NULL GROUP BY 1, event_type
"""

ACCUMULATORS = f"""
SELECT {floor_id(FIRST, DAY)} AS window_id, {FNV.format(key='event_type')} AS key_hash, count(value) AS count, round(sum(value), 4) AS sum_f64, round(min(value), 4) AS min_f64, round(max(value), 4) AS max_f64
FROM events WHERE ts IS NOT NULL GROUP BY 1, event_type
"""


def stream_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger carried from micro-batch to micro-batch, as it stands after each."""
    base, out = scratch(spark), []
    rows = settlement_orders(spark, folder).withColumn("batch", F.pmod("id", F.lit(3)))

    def call(df: DataFrame, prior: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        p = settlement_pipeline(df.sparkSession, df.drop("batch"))
        p.run()
        return df, ledger(p.workspace["Order"], prior)

    runner.stateful(call, as_stream(spark, rows, "batch", 3, base), f"{base}/state", f"{base}/checkpoint", lambda df, b: out.append(b), availableNow=True).awaitTermination()
    return spark.read.parquet(f"{base}/state").select(F.col("version").cast("bigint").alias("batch"), "settled_count", F.round("settled_usd", 2).alias("settled_usd"))


LEDGER = SETTLED + """
SELECT CAST(b AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS settled_count, round(sum(usd), 2) AS settled_usd FROM f, (VALUES (0), (1), (2)) AS t(b) WHERE settlement = 'SETTLED' AND id % 3 <= b GROUP BY b
"""

QUERIES = {"stream_late_windows": stream_late_windows, "stream_accumulators": stream_accumulators, "stream_sliding": stream_sliding, "stream_ledger": stream_ledger}
ORACLES = {
    "stream_late_windows": LATE_PARTS
    + """SELECT batch, CASE WHEN late THEN 'late' ELSE 'on_time' END AS kind, window_id, event_type, sum_value FROM f
UNION ALL SELECT batch, 'side_output', NULL, NULL, CAST(count(*) AS DOUBLE) FROM m WHERE gone GROUP BY batch""",
    "stream_accumulators": ACCUMULATORS,
    "stream_sliding": SLIDING,
    "stream_ledger": LEDGER,
}
