"""Planner, pipelines, scheduler, retries and workspaces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import ComponentNotFoundError, ConfigurationError, PermanentError, ResourceNotFoundError, RetryExhaustedError, SchedulerError, SchemaError, SystemExecutionError
from weirstone.operators.workspace import Workspace
from weirstone.plans import workloads
from weirstone.plans.meta import Access, System
from weirstone.plans.pipeline import Pipeline
from weirstone.plans.planner import stages
from weirstone.plans.retry import Retry
from weirstone.plans.scheduler import DATA, After, PipelineOptions, Scheduler
from weirstone.types import Component, fingerprint, parse_schema, parse_type

FIELDS = {"A": ["x", "y", "z"], "B": ["x"]}


def test_stages():
    a = Access("a").read("A", "x").write("A", "y")
    b = Access("b").read("A", "x").write("A", "z")
    c = Access("c").read("A", "y", "z").write("B")
    d = Access("d").write("A", "x")
    e = Access("e").read_resource("r")
    f = Access("f").write_resource("r")
    assert stages([a, b, c], FIELDS) == [[0, 1], [2]]
    assert stages([a, d], FIELDS) == [[0], [1]]  # d overwrites what a reads
    assert stages([e, f], FIELDS) == [[0], [1]]
    assert stages([a, a], FIELDS) == [[0], [1]]
    assert stages([], FIELDS) == []
    with pytest.raises(ConfigurationError):
        stages([Access("g").read("C")], FIELDS)
    with pytest.raises(ConfigurationError):
        stages([Access("g").read("A", "nothing")], FIELDS)


def test_fulfilment_levels(spark):
    p = workloads.fulfilment_pipeline(spark, workloads.fulfilment_orders(spark, "/root/testdata/sf0.001"))
    assert p.stages() == [["validate", "fraud", "exchange"], ["inventory", "tax"], ["approve"], ["invoice"]]


def test_settlement_values(spark):
    given = [(1, "EUR", 100.0), (2, "GBP", -5.0), (3, "JPY", 1_000_000.0), (4, "USD", 60_000.0), (5, "EUR", 0.0)]
    df = spark.createDataFrame(given, "id bigint, currency string, amount double").selectExpr("id", "'r' AS region", "currency", "amount", "false AS valid", "0D AS usd_amount", "0D AS risk_score", "false AS flagged", "'' AS settlement")
    p = workloads.settlement_pipeline(spark, df)
    p.run()
    got = p.workspace["Order"].orderBy("id").collect()
    assert [(r.valid, r.flagged, r.settlement) for r in got] == [(True, False, "SETTLED"), (False, False, "REJECTED"), (True, False, "SETTLED"), (True, True, "HOLD"), (False, False, "REJECTED")]
    assert [r.usd_amount for r in got] == pytest.approx([110.0, 0.0, 6800.0, 60_000.0, 0.0])
    assert [r.risk_score for r in got] == pytest.approx([0.0022, 0.0, 0.136, 1.2, 0.0])
    once = workloads.ledger(p.workspace["Order"])
    twice = workloads.ledger(p.workspace["Order"], once)
    assert (once.first().settled_count, twice.first().settled_count) == (2, 4)
    assert twice.first().settled_usd == pytest.approx(13_820.0)


def test_columns_see_the_rows_before_their_stage(spark):
    ws = Workspace(spark, {"A": spark.createDataFrame([(1, 2)], "x int, y int")})
    p = Pipeline("swap", ws)
    p.add_columns(Access("one").write("A", "x", "y"), lambda w: {"A": {"x": F.col("y"), "y": F.col("x")}})
    p.run()
    assert ws["A"].first() == (2, 1)


def test_checkpoints_end_the_lineage(spark):
    ws = Workspace(spark, {"A": spark.range(3).toDF("x")})
    p = Pipeline("p", ws)
    for name in ("one", "two"):
        p.add_columns(Access(name).read("A").write("A", "x"), lambda w: {"A": {"x": F.col("x") + 1}})
    p.run(checkpoint_every=1)
    assert sorted(r.x for r in ws["A"].collect()) == [2, 3, 4]
    assert "Range" not in ws["A"]._jdf.queryExecution().optimizedPlan().toString()


def test_undeclared_writes_are_refused(spark):
    ws = Workspace(spark, {"A": spark.createDataFrame([(1, 2)], "x int, y int")})
    p = Pipeline("p", ws).add_columns(Access("one").write("A", "x"), lambda w: {"A": {"y": F.lit(1)}})
    with pytest.raises(ConfigurationError):
        p.run()
    with pytest.raises(ConfigurationError):
        System(Access("none"))


def test_failed_step_is_taken_back_and_retried(spark):
    ws = Workspace(spark, {"A": spark.createDataFrame([(1,)], "x int")})
    tries = []

    def step(w):
        tries.append(1)
        w.append("A", spark.createDataFrame([(2,)], "x int"))
        if len(tries) < 3:
            raise ValueError("again")

    p = Pipeline("p", ws).add_step(Access("s").write("A"), step, retry=Retry.fixed(2, 0))
    stats = p.run(count=True)
    assert (stats.retries, stats.rows_produced, ws.rows("A")) == (2, 1, 2)


def test_retry():
    assert [Retry.exponential(jitter=0).delay_for(k) for k in (0, 1, 2, 20)] == [100, 200, 400, 30_000]
    assert all(90 <= Retry.exponential().delay_for(0) <= 110 for _ in range(50))
    slept = []
    with pytest.raises(RetryExhaustedError) as e:
        Retry.fixed(2, 50).call(lambda: 1 / 0, slept.append)
    assert e.value.attempts == 3 and slept == [0.05, 0.05] and isinstance(e.value.__cause__, ZeroDivisionError)
    with pytest.raises(ZeroDivisionError):
        Retry().call(lambda: 1 / 0)

    def final():
        raise PermanentError("no")

    with pytest.raises(PermanentError):
        Retry.fixed(5, 0).call(final)
    with pytest.raises(ConfigurationError):
        Retry(-1)


def chain(spark, name, n, log):
    p = Pipeline(name, Workspace(spark))
    p.workspace.register("rows", T.StructType([T.StructField("id", T.LongType())]))
    p.add_source("rows", lambda w: spark.range(n))
    return p.add_step(Access(name), lambda w: log.append(name))


def test_scheduler(spark):
    log: list[str] = []
    s = Scheduler()
    s.add(chain(spark, "late", 1, log), PipelineOptions((After("first"),), priority=5))
    s.add(chain(spark, "soon", 1, log), PipelineOptions((After("first"),), priority=1))
    s.add(chain(spark, "first", 0, log))
    s.add(chain(spark, "dry", 1, log), PipelineOptions((After("first", DATA),)))
    s.add(chain(spark, "drier", 1, log), PipelineOptions((After("dry", DATA),)))
    s.add(chain(spark, "held", 1, log), PipelineOptions(backpressure=lambda: True))
    tick = s.tick()
    assert log == ["first", "soon", "late"]
    assert set(tick.skipped) == {"dry", "drier", "held"}
    with pytest.raises(SchedulerError):
        s.add(chain(spark, "held", 1, log))
    with pytest.raises(SchedulerError):
        s.get("nothing")
    s.add(chain(spark, "x", 1, log), PipelineOptions((After("y"),)))
    with pytest.raises(SchedulerError):
        s.order()
    s.add(chain(spark, "y", 1, log), PipelineOptions((After("x"),)))
    with pytest.raises(SchedulerError):
        s.order()


def test_etl_report_literal(spark):
    df = spark.createDataFrame([(1, 100.0, "EUR"), (2, -1.0, "USD"), (3, 10.0, "XXX"), (4, None, "USD")], "id bigint, amount double, currency string").selectExpr("*", "false AS valid", "0D AS usd_amount")
    p = workloads.report_pipeline(spark, df)
    assert p.stages() == [["validate", "enrich"], ["report"]]
    p.run()
    r = p.workspace.resource("report").first()
    assert (r.total, r.valid, r.invalid, r.total_usd, r.avg_usd) == (4, 2, 2, 118.0, 59.0)


def test_workspace(spark):
    ws = Workspace(spark, resources={"a": 1})
    schema = parse_schema([{"name": "x", "type": "Int64"}, {"name": "t", "type": "varchar", "nullable": True}])
    ws.register("A", schema)
    ws.register("A", T.StructType())  # nothing happens
    ws.append("A", spark.createDataFrame([("b", 1), ("c", 2), ("d", None)], "t string, x bigint"))
    assert ws["A"].columns == ["x", "t"]
    ws.mark_dead("A", F.col("x") > 1)
    ws.mark_dead("A", F.col("x") > 1)
    assert (ws.rows("A"), ws.live_rows("A"), ws.should_compact("A")) == (3, 2, True)
    ws.compact()
    assert (ws.rows("A"), ws.should_compact("A")) == (2, False)
    with pytest.raises(SchemaError):
        ws.append("A", spark.createDataFrame([(1,)], "x bigint"))
    with pytest.raises(SchemaError):
        ws.apply("A", {"y": F.lit(1)})
    with pytest.raises(ComponentNotFoundError):
        ws["B"]
    with pytest.raises(ResourceNotFoundError):
        ws.resource("b")
    other = ws.clone_empty()
    assert other.rows("A") == 0 and not other.has_resource("a")
    ws.replace("A", spark.createDataFrame([(9, "z")], schema))
    assert [tuple(r) for r in ws.columns("A", "t").collect()] == [("z",)]
    ws.clear()
    assert ws.rows("A") == 0 and not ws.has_resource("a")


def test_types_and_versions(spark):
    assert parse_type("UInt64") == T.DecimalType(20, 0) and parse_type("DOUBLE") == T.DoubleType()
    with pytest.raises(ConfigurationError):
        parse_type("list")
    order = Component("Order", T.StructType([T.StructField(n, T.StringType()) for n in ("id", "region", "currency", "amount", "valid", "usd_amount", "risk_score", "flagged", "settlement")]))
    assert fingerprint([order]) == "d52f95a6"
    new = Component("A", T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]), 2, lambda df, v: df.withColumn("y", F.lit(0).cast("bigint")))
    assert new.current(spark.range(1).toDF("x"), 1).columns == ["x", "y"]
    with pytest.raises(SchemaError):
        new.current(spark.range(1).toDF("x"), 3)
    with pytest.raises(SchemaError):
        order.current(spark.range(1), 0)


def test_items_give_what_the_batch_gives(spark):
    def pipeline():
        ws = Workspace(spark)
        ws.register("A", T.StructType([T.StructField("v", T.LongType())]))
        return Pipeline("p", ws).add_source("A", lambda w: spark.range(0)).add_columns(Access("double").write("A", "v"), lambda w: {"A": {"v": F.col("v") * 2}})

    df = spark.range(100).toDF("v")
    whole = pipeline().run_items([df])[0]
    parts = pipeline().run_items([df.where(F.col("v") % 7 == k) for k in range(7)])
    assert sorted(r.v for r in whole.collect()) == sorted(r.v for p in parts for r in p.collect())


def test_failed_step_is_wholly_taken_back(spark):
    tries = []

    def run(w):
        w.register("Out", spark.range(1).schema)
        tries.append(1)
        if len(tries) < 2:
            w.insert_resource("half", 1)
            raise ValueError("not yet")
        assert list(w["Out"].collect()) == []
        w.append("Out", spark.range(3))

    p = Pipeline("p", Workspace(spark)).add_step(Access("s"), run, retry=Retry.fixed(2, 1))
    p.run()
    assert p.workspace["Out"].count() == 3 and "half" not in p.workspace._resources
