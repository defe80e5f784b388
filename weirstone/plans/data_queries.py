"""Sources, sinks, casts, mutation and the rest of the row operators, as queries."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import ConfigurationError, RetryExhaustedError
from weirstone.functions.aggregates import Reduce
from weirstone.operators.casting import cast_rows, target_schema
from weirstone.operators.digest import sha3
from weirstone.operators.lookup import enriched
from weirstone.operators.windows import Tumbling, Windowed
from weirstone.operators.workspace import Workspace
from weirstone.plans.meta import Access
from weirstone.plans.pipeline import Pipeline
from weirstone.plans.retry import Retry
from weirstone.plans.scheduler import DATA, After, PipelineOptions, Scheduler
from weirstone.plans.tables import HOUR, events, table
from weirstone.sources.files import CsvSource, FileSink, JsonSource, ParquetSource
from weirstone.sources.query import SqlSource, register_folder
from weirstone.streaming import runner


#: Numbers of a block of the range finder, and how many times blocks are gathered into larger ones.
BLOCK, LEVELS = 4096, 2


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; in local mode a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ConfigurationError("spark.checkpoint.dir isn't set: executors and driver need a folder that they share")
    return f"{base.rstrip('/')}/weirstone-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="weirstone-")


def alive_compact(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of which those with a status of F are dead, compacted."""
    ws = Workspace(spark, {"orders": table(spark, folder, "orders")})
    ws.mark_dead("orders", F.col("o_orderstatus") == "F")
    ws.mark_dead("orders", F.col("o_orderstatus") == "F")
    ws.compact()
    return ws["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def append_union(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and then suppliers as one component of parties."""
    c = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    ws = Workspace(spark)
    ws.register("party", c.schema)
    ws.append("party", c)
    ws.append("party", s)
    return ws["party"].groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


def cast_safe(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of which some are no numbers, cast to a target schema by name."""
    p = table(spark, folder, "part").select("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")).alias("p_size"), "p_partkey", "p_brand")
    target = target_schema(p.select("p_partkey", "p_size").schema, {"p_size": T.IntegerType(), "p_partkey": T.StringType()})
    return cast_rows(p, target)


def sql_passthrough(spark: SparkSession, folder: str) -> DataFrame:
    """Joins, ranking, a set operation and grouping sets by SQL text."""
    register_folder(spark, folder, ["customer", "orders", "nation", "region"])
    return SqlSource(SQL).read(spark)


SQL = """
WITH spent AS (
  SELECT c_custkey, c_nationkey, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey
), ranked AS (
  SELECT n_name, n_regionkey, c_custkey, total, row_number() OVER (PARTITION BY n_nationkey ORDER BY total DESC, c_custkey) AS place FROM spent JOIN nation ON n_nationkey = c_nationkey
)
SELECT r_name, n_name, c_custkey, total, CAST(place AS BIGINT) AS place FROM ranked JOIN region ON r_regionkey = n_regionkey WHERE place <= 3
UNION ALL
SELECT r_name, 'all', CAST(NULL AS BIGINT), round(sum(total), 2), CAST(0 AS BIGINT) FROM ranked JOIN region ON r_regionkey = n_regionkey GROUP BY r_name
"""


def lookup_join(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the segment of the customer 30 keys below theirs, or a default where there is none."""
    c = table(spark, folder, "customer").select((F.col("c_custkey") + 30).alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    rows = enriched(table(spark, folder, "orders"), "o_custkey", c, "segment", "NONE")
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def column_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of whole columns, 0 for one without values."""
    e = events(spark, folder).withColumn("nothing", F.lit(None).cast("double"))
    return e.agg(*(F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(f"sum_{c}") for c in ("value", "nothing")))


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges [first, after) that no order's number covers: neighbours more than one apart. Numbers are keys with two left free after each eight.

    Neighbours are found within blocks of numbers, then the blocks' ends within larger blocks, and so on: no task sorts more than BLOCK rows before the last step, which has one row for
    each BLOCK ** LEVELS numbers.
    """
    number = F.col("o_orderkey") + 2 * F.floor(F.col("o_orderkey") / 8)
    level = table(spark, folder, "orders").select(number.alias("low")).distinct().withColumn("high", F.col("low"))
    found = []
    for k in range(1, LEVELS + 2):
        block = F.floor(F.col("low") / F.lit(BLOCK) ** k) if k <= LEVELS else F.lit(0)
        own = Window.partitionBy("block").orderBy("low")
        pairs = level.withColumn("block", block).withColumn("before", F.lag("high").over(own))
        found.append(pairs.where("low > before + 1").select((F.col("before") + 1).alias("first"), F.col("low").alias("after")))
        level = level.groupBy(block.alias("block")).agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("block")
    return functools.reduce(DataFrame.unionByName, found)


def _roundtrip(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        s = table(spark, folder, "supplier")
        path = f"{scratch(spark)}/{kind}"
        FileSink(path, kind).write(s)
        source = {"csv": CsvSource(path, s.schema), "json": JsonSource(path, s.schema), "parquet": ParquetSource(path)}[kind]
        return source.read(spark).select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))

    return query


def sha3_digest(spark: SparkSession, folder: str) -> DataFrame:
    """SHA3-256 of 128-byte blobs made of part names."""
    blob = F.substring(F.rpad(F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_partkey").cast("string")), 128, "."), 1, 128).cast("binary")
    return sha3(table(spark, folder, "part").select("p_partkey", blob.alias("blob")), "blob").select("p_partkey", F.lower(F.hex("sha3_256")).alias("sha3_256"))


def doubled(spark: SparkSession, rows: DataFrame) -> Pipeline:
    """A pipeline that reads events and writes twice their value beside it."""
    ws = Workspace(spark)
    ws.register("event", rows.schema)
    return Pipeline("doubled", ws).add_source("event", lambda w: rows).add_columns(Access("double").read("event", "value").write("event", "twice"), lambda w: {"event": {"twice": F.col("value") * 2}})


def stream_equals_batch(spark: SparkSession, folder: str) -> DataFrame:
    """The same pipeline over one batch, over 1, 5 and 20 items of it, and over a stream of four files."""
    rows = events(spark, folder).select("event_id", "value", F.lit(0.0).alias("twice"))
    total = lambda df, form: df.agg(F.count("*").alias("n"), F.round(F.sum("twice"), 2).alias("total")).select(F.lit(form).alias("form"), "n", "total")
    whole = doubled(spark, rows)
    whole.run_with_io()
    out = [total(whole.workspace["event"], "batch")]
    for n in (1, 5, 20):
        items = doubled(spark, rows).run_items(rows.where(F.pmod("event_id", F.lit(n)) == k) for k in range(n))
        out.append(total(functools.reduce(DataFrame.unionByName, items), f"items_{n}"))
    base = scratch(spark)
    for k in range(4):
        rows.where(F.pmod("event_id", F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sink = FileSink(f"{base}/out", "parquet", mode="append")
    runner.stream(doubled(spark, rows).add_sink("event", sink.write), stream, f"{base}/checkpoint", availableNow=True).awaitTermination()
    out.append(total(spark.read.parquet(f"{base}/out"), "stream"))
    return functools.reduce(DataFrame.unionByName, out)


def scheduler_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Which of four pipelines run: one is skipped for want of rows, and the one after it for that."""
    nations = table(spark, folder, "nation")

    def make(name: str, rows: DataFrame) -> Pipeline:
        p = Pipeline(name, Workspace(spark))
        p.workspace.register("rows", nations.schema)
        return p.add_source("rows", lambda w: rows)

    s = Scheduler()
    s.add(make("full", nations)).add(make("empty", nations.where("n_nationkey < 0")), PipelineOptions((After("full"),)))
    s.add(make("after_empty", nations), PipelineOptions((After("empty", DATA),))).add(make("after_that", nations), PipelineOptions((After("after_empty", DATA),)))
    tick = s.tick()
    return spark.createDataFrame([(n, n in tick.ran) for n in s.pipelines], "pipeline string, ran boolean")


def retry_exhausted(spark: SparkSession, folder: str) -> DataFrame:
    """A system that fails for good, after three attempts, and one that works at the second."""
    tries = {"never": 0, "second": 0}

    def failing(name: str, good_at: int):
        def run(w: Workspace) -> None:
            tries[name] += 1
            if tries[name] < good_at:
                raise ValueError("not yet")

        return run

    out = []
    for name, good_at in (("never", 99), ("second", 2)):
        p = Pipeline(name, Workspace(spark)).add_step(Access(name), failing(name, good_at), retry=Retry.fixed(2, 1))
        try:
            p.run()
            out.append((name, tries[name], True))
        except RetryExhaustedError as e:
            out.append((name, e.attempts, False))
    return spark.createDataFrame(out, "system string, attempts int, succeeded boolean")


def sales_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """Half-minute windows of purchases by kind of event."""
    return Windowed("ts", Tumbling(30_000), Reduce("value"), ["event_type"]).run(events(spark, folder).where("event_type = 'purchase'")).drop("key_hash").withColumn("sum_value", F.round("sum_value", 4))


def hourly_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users, first and last event of each hour and kind."""
    e = events(spark, folder).withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.groupBy("event_type", F.call_function("div", F.unix_micros("hour"), F.lit(HOUR * 1000)).alias("hour")).agg(F.countDistinct("user_id").alias("users"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


ROUNDTRIP = "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier"
QUERIES = {
    "alive_compact": alive_compact,
    "append_union": append_union,
    "cast_safe": cast_safe,
    "sql_passthrough": sql_passthrough,
    "lookup_join": lookup_join,
    "column_sum": column_sum,
    "range_gaps": gaps,
    "io_roundtrip_csv": _roundtrip("csv"),
    "io_roundtrip_json": _roundtrip("json"),
    "io_roundtrip_parquet": _roundtrip("parquet"),
    "sha3_udf": sha3_digest,
    "stream_equals_batch": stream_equals_batch,
    "scheduler_skip": scheduler_skip,
    "retry_exhausted": retry_exhausted,
    "sales_by_category": sales_by_category,
    "hourly_users": hourly_users,
}
ORACLES = {
    "alive_compact": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY o_orderstatus",
    "append_union": "SELECT nation, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY nation",
    "cast_safe": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size FROM part",
    "sql_passthrough": SQL,
    "lookup_join": "SELECT coalesce(c_mktsegment, 'NONE') AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON c_custkey + 30 = o_custkey GROUP BY 1",
    "column_sum": "SELECT round(coalesce(sum(value), 0.0), 2) AS sum_value, 0.0::DOUBLE AS sum_nothing FROM events",
    "range_gaps": "SELECT before + 1 AS first, k AS after FROM (SELECT k, lag(k) OVER (ORDER BY k) AS before FROM (SELECT DISTINCT o_orderkey + 2 * (o_orderkey // 8) AS k FROM orders)) WHERE k > before + 1",
    "io_roundtrip_csv": ROUNDTRIP,
    "io_roundtrip_json": ROUNDTRIP,
    "io_roundtrip_parquet": ROUNDTRIP,
    "stream_equals_batch": "SELECT form, count(*) AS n, round(sum(value * 2), 2) AS total FROM events, (VALUES ('batch'), ('items_1'), ('items_5'), ('items_20'), ('stream')) AS t(form) GROUP BY form",
    "scheduler_skip": "SELECT * FROM (VALUES ('full', true), ('empty', true), ('after_empty', false), ('after_that', false)) AS t(pipeline, ran)",
    "retry_exhausted": "SELECT * FROM (VALUES ('never', 3, false), ('second', 2, true)) AS t(system, attempts, succeeded)",
    "sales_by_category": "SELECT CAST(epoch_us(ts) // 30000000 AS BIGINT) AS window_id, event_type, round(sum(value), 4) AS sum_value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2",
    "hourly_users": "SELECT event_type, CAST(epoch_us(date_trunc('hour', ts)) // 3600000000 AS BIGINT) AS hour, count(DISTINCT user_id) AS users, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2",
}
