"""Files, casts, SQL, channels, snapshots, TCP, configuration and streams."""

from __future__ import annotations

import hashlib
import socket
import struct
import time
import urllib.request

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.__main__ import main
from weirstone.errors import ConfigurationError, EngineError, SchemaError, StoreError
from weirstone.functions.aggregates import Reduce
from weirstone.operators import accumulator
from weirstone.operators.casting import cast_rows, target_schema
from weirstone.operators.digest import sha3
from weirstone.operators.lookup import enriched, mapped
from weirstone.operators.windows import Tumbling, Windowed
from weirstone.operators.workspace import Workspace
from weirstone.plans import config
from weirstone.plans.meta import Access
from weirstone.plans.pipeline import Pipeline
from weirstone.sources import snapshot, tcp
from weirstone.sources.channel import ChannelSink, ChannelSource
from weirstone.sources.files import CastingSource, CsvSource, FileSink, JsonSource, ParquetSource, json_rows
from weirstone.sources.query import SqlSource
from weirstone.sources.registry import Registry
from weirstone.streaming import runner
from weirstone.streaming.guest import ArrowGuest, Chain
from weirstone.streaming.late_windows import LateWindows, native
from weirstone.streaming.status import StatusPage
from weirstone.types import Component

ROWS = [(1, "a", 1.5), (2, None, None), (3, "é,\"x\"", -2.0)]
SCHEMA = "id bigint, name string, v double"


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"{tmp_path}/out"
    FileSink(path, kind).write(df)
    FileSink(path, kind).write(df)  # takes the place of the first
    source = {"parquet": ParquetSource(path), "csv": CsvSource(path, df.schema), "json": JsonSource(path, df.schema)}[kind]
    assert got(source.read(spark)) == got(df)
    cast = CastingSource(source, T.StructType([T.StructField("v", T.StringType()), T.StructField("id", T.IntegerType())]))
    assert cast.read(spark).dtypes == [("v", "string"), ("id", "int")]


def test_json_schema_is_inferred_from_the_first_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert JsonSource(str(tmp_path)).read(spark).columns == ["a", "b"]
    assert JsonSource(str(tmp_path), infer_records=1).read(spark).columns == ["a"]
    assert got(json_rows(spark, b'{"a": 1}\n{"a": null}\n')) == [(1,), (None,)]
    with pytest.raises(SchemaError):
        json_rows(spark, b"\n")


def test_csv_fails_on_bad_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id\nnone\n")
    with pytest.raises(Exception, match="(?i)malformed|failfast|cast"):
        CsvSource(str(tmp_path), T.StructType([T.StructField("id", T.LongType())])).read(spark).collect()


def test_casts(spark):
    df = spark.createDataFrame([("1", 2.9, 0), ("x", None, 1)], "a string, b double, c int")
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.IntegerType())])
    assert got(cast_rows(df, schema)) == [(2, 1), (None, None)]
    with pytest.raises(Exception, match="(?i)cast"):
        cast_rows(df, schema, safe=False).collect()
    with pytest.raises(SchemaError):
        cast_rows(df, T.StructType([T.StructField("d", T.LongType())]))
    assert target_schema(df.schema, {"c": T.LongType()})["c"].dataType == T.LongType()
    with pytest.raises(SchemaError):
        target_schema(df.schema, {"d": T.LongType()})


def test_lookups(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r[0] for r in df.select(mapped(F.col("k"), {"a": 2.0}, 1.0)).collect()] == [2.0, 1.0, 1.0]
    assert [r[0] for r in df.select(mapped(F.col("k"), {}, 1.0)).collect()] == [1.0] * 3
    with pytest.raises(ConfigurationError):
        mapped(F.col("k"), {str(k): k for k in range(300)}, 0)
    table = spark.createDataFrame([("a", 5)], "k string, n int")
    assert got(enriched(df, "k", table, "n", 0)) == [("a", 5), ("b", 0), (None, 0)]


def test_sha3(spark):
    df = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b""),), (None,)], "b binary")
    want = [hashlib.sha3_256(b"x").digest(), hashlib.sha3_256(b"").digest(), None]
    assert [None if r.sha3_256 is None else bytes(r.sha3_256) for r in sha3(df, "b").collect()] == want


def test_sql_source(spark):
    df = spark.range(10)
    assert SqlSource("SELECT count(*) FROM numbers WHERE id > :least", {"numbers": df}, {"least": 3}).read(spark).first()[0] == 6


def test_scans_are_pruned_and_filtered(spark, tmp_path):
    FileSink(f"{tmp_path}/p").write(spark.createDataFrame(ROWS, SCHEMA))
    plan = ParquetSource(f"{tmp_path}/p").read(spark).where("id > 1").select("v")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in plan and "name" not in plan.rsplit("ReadSchema", 1)[1]


def test_channels(spark):
    source = ChannelSource(T.StructType([T.StructField("v", T.LongType())]), capacity=2)
    assert source.send([(1,), (2,)]) and source.send([(3,)]) and not source.send([(4,)])
    with pytest.raises(SchemaError):
        ChannelSource(source.schema).send([(1, 2)])
    assert got(source.read(spark)) == [(1,), (2,), (3,)]
    source.send([(5,)])
    source.close()
    assert [got(b) for b in source.batches(spark)] == [[(5,)]]
    with pytest.raises(EngineError):
        source.send([(6,)])
    sink = ChannelSink()
    sink.write(spark.range(2))
    assert sink.pending_batches() == 1 and sink.take().count() == 2 and sink.take() is None


def test_snapshots(spark):
    ws = Workspace(spark, {"B": spark.createDataFrame(ROWS, SCHEMA), "A": spark.range(2)})
    ws.mark_dead("B", F.col("id") == 2)
    data = snapshot.write(ws)
    back = snapshot.read(spark, data)
    assert got(back["B"]) == got(ws["B"]) and back.live_rows("B") == 2 and back.fingerprint() == ws.fingerprint()
    assert data.endswith(struct.pack("<I", 0))
    newer = Component("A", T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())]), 2, lambda df, v: df.withColumn("n", F.lit(v).cast("bigint")))
    assert got(snapshot.read(spark, data, {"A": newer})["A"]) == [(0, 1), (1, 1)]
    for bad in (data[:-4], data[:10], b"\x08\0\0\0abcdefgh"):
        with pytest.raises(StoreError):
            snapshot.read(spark, bad)
    assert len(snapshot.write_component(ws, "A")) > 4


def test_saved_tables(spark, tmp_path):
    ws = Workspace(spark, {"B": spark.createDataFrame(ROWS, SCHEMA)})
    ws.mark_dead("B", F.col("id") == 2)
    assert snapshot.load_tables(spark, f"{tmp_path}/none") is None
    snapshot.save_tables(ws, f"{tmp_path}/t")
    back = snapshot.load_tables(spark, f"{tmp_path}/t")
    assert got(back["B"]) == got(ws["B"]) and back.live_rows("B") == 2 and back.fingerprint() == ws.fingerprint()


def test_tcp_frames():
    schema = pa.schema([("v", pa.int64())])
    own = tcp.Listener("127.0.0.1", 0, schema, buffer=8, most_bytes=10_000)

    def send(*parts):
        with socket.create_connection(own.address[:2]) as c:
            for p in parts:
                c.sendall(p)

    good = tcp.pack(pa.record_batch({"v": pa.array([1, 2])}))
    send(struct.pack(">I", 0), good, good)
    send(good[:-3])  # cut off
    send(struct.pack(">I", 20_000), good)  # too long
    send(struct.pack(">I", 4) + b"junk", good)
    send(tcp.pack(pa.record_batch({"w": pa.array(["x"])})), good)  # another schema
    send(good)
    for _ in range(100):
        if own.next == 3:
            break
        time.sleep(0.05)
    assert own.next == 3 and [b.num_rows for b in own.between(0, 3)] == [2, 2, 2]
    own.forget(2)
    assert list(own.frames) == [2]
    own.close()


def test_tcp_stream(spark, tmp_path):
    tcp.register(spark)
    where = tmp_path / "address"
    df = spark.readStream.format(tcp.FORMAT).schema("v bigint").option("bind", "127.0.0.1:0").option("address_file", str(where)).load()
    q = df.writeStream.format("memory").queryName("tcp_rows").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        for _ in range(200):
            if where.exists() and where.read_text():
                break
            time.sleep(0.1)
        host, port = where.read_text().split(":")
        with socket.create_connection((host, int(port))) as c:
            c.sendall(tcp.pack(pa.record_batch({"v": pa.array([7, 8, 9])})))
        for _ in range(200):
            if spark.table("tcp_rows").count() == 3:
                break
            time.sleep(0.1)
        assert got(spark.table("tcp_rows")) == [(7,), (8,), (9,)]
    finally:
        q.stop()


def file_stream(spark, tmp_path, batches, schema):
    """A stream with a micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/part{k}")
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{k}.parquet")
            time.sleep(0.05)
            (tmp_path / "in" / f"{k}.parquet").touch()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_runs_equal_batch_runs(spark, tmp_path):
    op = Windowed("ts", Tumbling(2000), Reduce("v"), ["k"], allowed_lateness_ms=1000)
    batches = [[("a", 1000, 1.0), ("a", 2000, 2.0), ("b", 3000, 3.0)], [("a", 2500, 4.0)], [("a", 1500, 5.0), ("b", 2100, 6.0)]]
    stream = file_stream(spark, tmp_path, batches, "k string, ts bigint, v double")
    late = LateWindows(op, f"{tmp_path}/state")
    late.start(stream, f"{tmp_path}/check", availableNow=True).awaitTermination()
    values = lambda n: sorted((r.batch, r.k, r.window_id, r.sum_v) for r in late.results(spark, n).collect())
    assert values("on_time") == [(0, "a", 0, 1.0), (0, "a", 1, 2.0), (0, "b", 1, 3.0)]
    assert values("late") == [(1, "a", 1, 4.0), (2, "b", 1, 6.0)]
    assert [(r.batch, r.ts) for r in late.results(spark, "side_output").collect()] == [(2, 1500)]
    again = late.run(spark.createDataFrame(batches[1], "k string, ts bigint, v double"), 1)  # a replay
    assert got(again.late.select("window_id", "sum_v")) == [(1, 4.0)] and again.on_time.isEmpty()


def test_native_windows(spark, tmp_path):
    from datetime import datetime

    rows = [[("a", datetime(2024, 1, 1, 0, 0, s), 1.0) for s in (1, 2, 12)], [("a", datetime(2024, 1, 1, 0, 1), 1.0)], [("a", datetime(2024, 1, 1, 0, 5), 1.0)]]
    stream = file_stream(spark, tmp_path, rows, "k string, ts timestamp, v double")
    q = native(Windowed("ts", Tumbling(10_000), Reduce("v"), ["k"], allowed_lateness_ms=1000), stream, "ts").writeStream.format("memory").queryName("native_rows").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.sum_v for r in spark.table("native_rows").collect()) == [1.0, 1.0, 2.0]


def test_stream_of_a_pipeline_and_state(spark, tmp_path):
    schema = "v bigint"
    stream = file_stream(spark, tmp_path, [[(1,)], [(2,)], [(3,)]], schema)
    out = []
    ws = Workspace(spark)
    ws.register("A", T.StructType([T.StructField("v", T.LongType())]))
    p = Pipeline("p", ws).add_source("A", lambda w: None).add_columns(Access("x").write("A", "v"), lambda w: {"A": {"v": F.col("v") * 10}}).add_sink("A", lambda df: out.extend(r.v for r in df.collect()))
    counters = runner.Counters()
    runner.stream(p, stream, f"{tmp_path}/c", counters, availableNow=True).awaitTermination()
    assert sorted(out) == [10, 20, 30] and counters.runs == 3
    seen = {}

    def call(df, prior):
        total = df.unionByName(prior) if prior is not None else df
        return df, total.agg(F.sum("v").alias("v"))

    runner.stateful(call, stream, f"{tmp_path}/s", f"{tmp_path}/c2", lambda df, b: seen.setdefault(b, df.count()), availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s/version=2").first().v == 6 and seen == {0: 1, 1: 1, 2: 1}


def test_driver_counts_errors_and_goes_on(spark):
    ws = Workspace(spark)
    ws.register("A", T.StructType([T.StructField("id", T.LongType())]))
    written = []
    p = Pipeline("p", ws).add_source("A", lambda w: 1 / 0).add_step(Access("x"), lambda w: 1 / 0).add_sink("A", lambda df: written.append(df.count()))
    c = runner.Driver(p, runner.INTERVAL, 1).run(most_runs=2)
    assert (c.source_errors, c.runtime_errors, c.sink_errors, c.runs, written) == (2, 2, 0, 0, [0, 0])
    with pytest.raises(ConfigurationError):
        runner.Driver(p, "sometimes")
    with pytest.raises(ConfigurationError):
        runner.Driver(p, runner.INTERVAL)
    with pytest.raises(ConfigurationError):
        runner.Driver(p, runner.STREAM).run()


def test_status_page(capsys):
    c = runner.Counters()
    page = StatusPage(c, "n")
    try:
        address = f"{page.address[0]}:{page.address[1]}"
        assert page.answer("/ready")[0] == 503 and page.answer("/none")[0] == 404
        c.runs = 2
        assert page.answer("/ready")[0] == 200 and "weirstone_runs 2" in page.answer("/metrics")[2]
        with urllib.request.urlopen(f"http://{address}/health") as answer:
            assert answer.read() == b"ok"
        assert main(["status", address]) == 0 and '"runs": 2' in capsys.readouterr().out
    finally:
        page.close()
    assert main(["status", address]) == 1


def test_guests(spark):
    component = Component("A", T.StructType([T.StructField("v", T.LongType())]))

    def plus(batch: pa.RecordBatch, conf) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() + int(conf["n"]) for x in batch.column(0)], pa.int64())], ["v"])

    one = ArrowGuest(plus, component, component.schema, {"n": "1"})
    two = ArrowGuest(plus, component, component.schema, {"n": "10"})
    out, states = Chain([one, two]).run_batch(spark.range(3).toDF("v"))
    assert got(out) == [(11,), (12,), (13,)] and states == [None, None]
    other = ArrowGuest(plus, Component("B", component.schema), component.schema)
    with pytest.raises(ConfigurationError):
        Chain([one, other])


def test_accumulators(spark):
    op = Windowed("ts", Tumbling(1000), Reduce("v"), ["k"], source="s")
    a = accumulator.accumulated(op, spark.createDataFrame([("x", 1, 2.0), ("x", 2, None)], "k string, ts bigint, v double"), 2)
    b = accumulator.accumulated(op, spark.createDataFrame([("x", 3, 5.0), ("y", 1500, 1.0)], "k string, ts bigint, v double"), 1500)
    both = accumulator.merge(a, b).orderBy("window_id").collect()
    assert [(r["count"], r.sum_f64, r.min_f64, r.max_f64, r.finalized_at_watermark) for r in both] == [(2, 7.0, 2.0, 5.0, 1500), (1, 1.0, 1.0, 1.0, 1500)]
    last = accumulator.merge(a, b, "latest").orderBy("window_id").collect()
    assert [r.sum_f64 for r in last] == [5.0, 1.0]
    assert [r[0] for r in accumulator.merge(a, b).orderBy("window_id").select(accumulator.value("mean")).collect()] == [3.5, 1.0]
    with pytest.raises(SchemaError):
        accumulator.migrate_to_current(a, 2)
    assert accumulator.migrate_to_current(a, None).count() == 1


CONFIG = """
mode = "standalone"
[node]
id = "${NODE:-1}"
name = "n"
data_dir = "${DATA}"
[run_mode]
kind = "one_shot"
[http]
disabled = true
[pipeline.python]
module = "MODULE"
[pipeline.python.config]
factor = "3"
[[sources]]
name = "in"
type = "CsvSource"
target_component = "A"
config = { path = "IN", schema = [{ name = "v", type = "int64" }] }
[[sinks]]
name = "out"
type = "ParquetSink"
source_component = "A"
config = { path = "OUT" }
"""

MODULE = """
from pyspark.sql import functions as F, types as T
from weirstone.operators.workspace import Workspace
from weirstone.plans.meta import Access
from weirstone.plans.pipeline import Pipeline

def build(spark, config):
    ws = Workspace(spark)
    ws.register("A", T.StructType([T.StructField("v", T.LongType())]))
    return Pipeline("p", ws).add_columns(Access("x").write("A", "v"), lambda w: {"A": {"v": F.col("v") * int(config["factor"])}})
"""


def test_configuration_is_served(spark, tmp_path, capsys):
    (tmp_path / "m.py").write_text(MODULE)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("v\n1\n2\n")
    text = CONFIG.replace("MODULE", f"{tmp_path}/m.py").replace("IN", f"{tmp_path}/in").replace("OUT", f"{tmp_path}/out").replace("${DATA}", str(tmp_path))
    (tmp_path / "c.toml").write_text(text)
    assert main(["validate", f"{tmp_path}/c.toml"]) == 0 and "valid" in capsys.readouterr().out
    assert main(["serve", f"{tmp_path}/c.toml"]) == 0
    assert got(spark.read.parquet(f"{tmp_path}/out")) == [(3,), (6,)]
    assert main(["validate", f"{tmp_path}/none.toml"]) == 1 and main(["query", "none", "x"]) == 1


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (("${DATA}", ""), "data_dir"),
        (('"standalone"', '"cluster"'), "peers"),
        (('"one_shot"', '"sometimes"'), "run mode"),
        (('"one_shot"', '"interval"'), "interval_ms"),
        (('"CsvSource"', '"tcp"'), "never ends"),
        (("disabled = true", 'bind = "nowhere"'), "no address"),
        (("mode =", "mode ="), None),
    ],
)
def test_configuration_rules(change, message):
    text = CONFIG.replace(*change)
    if message is None:
        conf = config.parse(text, {"DATA": "/d"})
        assert (conf.node_id, conf.run_mode, conf.program_config) == (1, "one_shot", {"factor": "3"})
        with pytest.raises(ConfigurationError):
            conf.check_components({"B"})
    else:
        with pytest.raises(ConfigurationError, match=message):
            config.parse(text, {"DATA": "/d"})


def test_cluster_rules_and_placeholders():
    base = 'mode = "cluster"\nPEERS\n[node]\nid = 1\ndata_dir = "/d"\n[http]\ndisabled = true\n'
    ok = 'peers = [{ id = 1, addr = "a" }, { id = 2, addr = "b" }]'
    assert config.parse(base.replace("PEERS", ok)).lease_ttl_ms == 30_000
    for bad in (ok.replace("id = 2", "id = 1"), ok.replace("id = 1", "id = 3"), ok + "\nlease_ttl_ms = 4000"):
        with pytest.raises(ConfigurationError):
            config.parse(base.replace("PEERS", bad))
    assert config.substituted("a${X:-b}c${Y}", {"Y": "d"}) == "abcd"
    for bad in ("${X}", "${X"):
        with pytest.raises(ConfigurationError):
            config.substituted(bad, {})


def test_registry():
    r = Registry()
    assert isinstance(r.source("ParquetSource", {"path": "x"}), ParquetSource)
    for kind, options in (("none", {}), ("CsvSource", {"path": "x"}), ("ParquetSource", {})):
        with pytest.raises(ConfigurationError):
            r.source(kind, options)
    r.register_source("mine", lambda o: o)
    assert r.source("mine", {"a": 1}) == {"a": 1}
    with pytest.raises(ConfigurationError):
        r.register_sink("CsvSink", lambda o: o)


def test_failed_batches_fail_the_query_unless_dropped(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    def pipeline():
        ws = Workspace(spark)
        ws.register("A", T.StructType([T.StructField("v", T.LongType())]))

        def odd(w):
            if w["A"].where("v = 2").count():
                raise ValueError("two")

        return Pipeline("p", ws).add_source("A", lambda w: None).add_step(Access("odd").read("A", "v"), odd).add_sink("A", lambda df: out.extend(r.v for r in df.collect()))

    out = []
    stream = file_stream(spark, tmp_path, [[(1,)], [(2,)], [(3,)]], "v bigint")
    with pytest.raises(StreamingQueryException):
        runner.stream(pipeline(), stream, f"{tmp_path}/c", availableNow=True).awaitTermination()
    out.clear()
    counters = runner.Counters()
    runner.stream(pipeline(), stream, f"{tmp_path}/d", counters, drop_failed=True, availableNow=True).awaitTermination()
    assert out == [1, 3] and counters.runtime_errors == 1
