"""What moves rows between sources, workspaces, stores and sinks, as queries."""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.functions.aggregates import Reduce
from weirstone.operators.digest import sha3
from weirstone.operators.slices import row_range, run_slices
from weirstone.operators.windows import Tumbling, Windowed
from weirstone.operators.workspace import Workspace
from weirstone.plans.data_queries import doubled, scratch
from weirstone.plans.meta import Access
from weirstone.plans.pipeline import Pipeline
from weirstone.plans.scheduler import After, PipelineOptions, Scheduler
from weirstone.plans.tables import DAY, events, table
from weirstone.sources import snapshot
from weirstone.sources.channel import ChannelSink, ChannelSource
from weirstone.sources.files import CastingSource, FileSink, ParquetSource
from weirstone.sources.query import SqlSource
from weirstone.sources.registry import Registry


def drain_to_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers from an SQL source through a system into a Parquet sink, read back."""
    path = f"{scratch(spark)}/out"
    source = SqlSource("SELECT s_suppkey, s_nationkey, s_acctbal, 0.0D AS doubled FROM supplier_in", {"supplier_in": table(spark, folder, "supplier")})
    ws = Workspace(spark)
    ws.register("s", source.read(spark).schema)
    p = Pipeline("drain", ws).add_source("s", lambda w: source.read(spark)).add_sink("s", FileSink(path).write)
    p.add_columns(Access("double").read("s", "s_acctbal").write("s", "doubled"), lambda w: {"s": {"doubled": F.col("s_acctbal") * 2}})
    p.run_with_io()
    return ParquetSource(path).read(spark)


def channel_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Nations through an in-process channel, batch by batch, into another."""
    nations = table(spark, folder, "nation")
    rows = [tuple(r) for r in nations.orderBy("n_nationkey").collect()]  # a channel's rows come from the program itself
    source, sink = ChannelSource(nations.schema), ChannelSink()
    for k in range(0, len(rows), 10):
        source.send(rows[k : k + 10])
    source.close()
    for number, df in enumerate(source.batches(spark)):
        sink.write(df.withColumn("batch", F.lit(number).cast("bigint")))
    return functools.reduce(DataFrame.unionByName, (sink.take() for _ in range(sink.pending_batches())))


def snapshot_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Nations and regions written as Arrow streams with the dead rows marked, read back and compacted."""
    ws = Workspace(spark, {"nation": table(spark, folder, "nation"), "region": table(spark, folder, "region")})
    ws.mark_dead("nation", F.col("n_regionkey") == 1)
    back = snapshot.read(spark, snapshot.write(ws))
    back.compact()
    return back["nation"].join(back["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def archive_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers saved as an archive of tables, loaded and summed."""
    path = f"{scratch(spark)}/archive"
    ws = Workspace(spark, {"customer": table(spark, folder, "customer")})
    ws.mark_dead("customer", F.col("c_acctbal") < 0)
    snapshot.save_tables(ws, path)
    back = snapshot.load_tables(spark, path)
    back.compact()
    return back["customer"].groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def registry_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Parts into a CSV sink and out of a CSV source that the registry makes from options."""
    registry, path = Registry(), f"{scratch(spark)}/parts"
    registry.sink("CsvSink", {"path": path}).write(table(spark, folder, "part").select("p_partkey", "p_brand", "p_size"))
    fields = [{"name": "p_partkey", "type": "Int64"}, {"name": "p_brand", "type": "Utf8"}, {"name": "p_size", "type": "Int32"}]
    return registry.source("CsvSource", {"path": path, "schema": fields}).read(spark).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))


def casting_source(spark: SparkSession, folder: str) -> DataFrame:
    """Customers from a source that casts: keys to texts, balances to whole numbers."""
    schema = T.StructType([T.StructField("c_custkey", T.StringType()), T.StructField("c_acctbal", T.LongType())])
    return CastingSource(ParquetSource(f"{folder}/customer.parquet"), schema).read(spark)


def sql_each_batch(spark: SparkSession, folder: str) -> DataFrame:
    """One SQL text over each of three batches of lineitem."""
    rows = table(spark, folder, "lineitem")
    source = SqlSource("SELECT CAST(min(l_suppkey % 3) AS BIGINT) AS batch, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lines_in")
    return functools.reduce(DataFrame.unionByName, source.read_each(spark, "lines_in", (rows.where(F.col("l_suppkey") % 3 == k) for k in range(3))))


def row_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Customers 100 to 139 in the order of balance and key."""
    return row_range(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], 100, 40)


def slice_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, sums and bounds of quantities by flag, made slice by slice and merged."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = pa.Table.from_batches([batch]).group_by("l_returnflag").aggregate([("l_quantity", "count"), ("l_quantity", "sum"), ("l_quantity", "max")])
        return got.select(["l_returnflag", "l_quantity_count", "l_quantity_sum", "l_quantity_max"]).rename_columns(["flag", "n", "total", "most"]).combine_chunks().to_batches()[0]

    def merge(slices: DataFrame) -> DataFrame:
        return slices.groupBy("flag").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"), F.max("most").alias("most"))

    return run_slices(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity"), one, "flag string, n bigint, total double, most double", merge)


def event_time_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The same daily sums with event times as timestamps and as milliseconds."""
    e = events(spark, folder)
    millis = e.withColumn("ts", F.call_function("div", F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000)))
    op = Windowed("ts", Tumbling(DAY), Reduce("value"))
    return op.run(e).withColumn("form", F.lit("timestamp")).unionByName(op.run(millis).withColumn("form", F.lit("millis"))).select("form", "window_id", F.round("sum_value", 4).alias("sum_value"))


def scheduler_order(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that a chain of pipelines, added last first, has made in one tick: each reads what the one before it wrote. One under backpressure makes none."""
    base, s = scratch(spark), Scheduler()
    rows = events(spark, folder).select("event_id", "value", F.lit(0.0).alias("twice"))

    def reading(path: str) -> DataFrame:
        return spark.read.parquet(path).select("event_id", F.col("twice").alias("value"), F.lit(0.0).alias("twice"))

    for k in (2, 1, 0):
        p = doubled(spark, rows)
        if k:
            p.sources = [("event", lambda w, path=f"{base}/{k - 1}": reading(path))]
        p.name = f"step{k}"
        s.add(p.add_sink("event", FileSink(f"{base}/{k}").write), PipelineOptions((After(f"step{k - 1}"),) if k else ()))
    held = doubled(spark, rows)
    held.name = "held9"
    s.add(held.add_sink("event", FileSink(f"{base}/9").write), PipelineOptions(backpressure=lambda: True))
    ran = s.tick().ran
    totals = [spark.read.parquet(f"{base}/{name[-1]}").agg(F.count("*").alias("n"), F.round(F.sum("twice"), 2).alias("total")).select(F.lit(name).alias("pipeline"), "n", "total") for name in ran]
    return functools.reduce(DataFrame.unionByName, totals)


def resource_update(spark: SparkSession, folder: str) -> DataFrame:
    """A mean that one stage puts among the resources and the next one subtracts."""
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal", F.lit(0.0).alias("off"))
    ws = Workspace(spark, {"c": rows})
    p = Pipeline("centred", ws)
    p.add_step(Access("mean").read("c", "c_acctbal").write_resource("mean"), lambda w: None, resources=lambda w: {"mean": w["c"].agg(F.round(F.avg("c_acctbal"), 2)).first()[0]})
    p.add_columns(Access("centre").read("c", "c_acctbal").read_resource("mean").write("c", "off"), lambda w: {"c": {"off": F.col("c_acctbal") - w.resource("mean")}})
    p.run()
    return ws["c"].select("c_custkey", F.round("off", 2).alias("off"))


def sha3_regions(spark: SparkSession, folder: str) -> DataFrame:
    """SHA3-256 of region names."""
    return sha3(table(spark, folder, "region").select("r_regionkey", F.col("r_name").cast("binary").alias("name")), "name").select("r_regionkey", F.lower(F.hex("sha3_256")).alias("sha3_256"))


#: The names of the regions, whose digests the SQL side is given.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_DIGESTS = " ".join(f"WHEN '{r}' THEN '{hashlib.sha3_256(r.encode()).hexdigest()}'" for r in REGIONS)

QUERIES = {
    "drain_to_sink": drain_to_sink,
    "channel_roundtrip": channel_roundtrip,
    "snapshot_roundtrip": snapshot_roundtrip,
    "archive_roundtrip": archive_roundtrip,
    "registry_roundtrip": registry_roundtrip,
    "casting_source": casting_source,
    "sql_each_batch": sql_each_batch,
    "row_slice": row_slice,
    "slice_merge": slice_merge,
    "event_time_forms": event_time_forms,
    "scheduler_order": scheduler_order,
    "resource_update": resource_update,
    "sha3_regions": sha3_regions,
}
ORACLES = {
    "drain_to_sink": "SELECT s_suppkey, s_nationkey, s_acctbal, s_acctbal * 2 AS doubled FROM supplier",
    "channel_roundtrip": "SELECT *, CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS BIGINT) AS batch FROM nation",
    "snapshot_roundtrip": "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 1",
    "archive_roundtrip": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal >= 0 GROUP BY 1",
    "registry_roundtrip": "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM part GROUP BY 1",
    "casting_source": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal FROM customer",
    "sql_each_batch": "SELECT CAST(l_suppkey % 3 AS BIGINT) AS batch, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
    "row_slice": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 40 OFFSET 100",
    "slice_merge": "SELECT l_returnflag AS flag, count(l_quantity) AS n, round(sum(l_quantity), 2) AS total, max(l_quantity) AS most FROM lineitem GROUP BY 1",
    "event_time_forms": "SELECT form, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS window_id, round(sum(value), 4) AS sum_value FROM events, (VALUES ('timestamp'), ('millis')) AS t(form) WHERE ts IS NOT NULL GROUP BY 1, 2",
    "scheduler_order": "SELECT 'step' || k AS pipeline, count(*) AS n, round(sum(value * f), 2) AS total FROM events, (VALUES (0, 2), (1, 4), (2, 8)) AS t(k, f) GROUP BY k",
    "resource_update": "SELECT c_custkey, round(c_acctbal - (SELECT round(avg(c_acctbal), 2) FROM customer), 2) AS off FROM customer",
    "sha3_regions": f"SELECT r_regionkey, CASE r_name {_DIGESTS} END AS sha3_256 FROM region",
}
