"""Windows, sessions, lateness and process functions on literal rows with exact expectations."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirstone.errors import ConfigurationError, SchemaError
from weirstone.functions.aggregates import Reduce
from weirstone.functions.event_time import millis, sliding_ids, tumbling_id
from weirstone.functions.key_hash import key_hash
from weirstone.operators.lateness import WatermarkState, over_runs
from weirstone.operators.windows import Process, Session, Sliding, Tumbling, Windowed, WindowContext


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def frame(spark, values):
    return spark.createDataFrame(values, "ts bigint, v double")


@pytest.mark.parametrize(
    ("times", "offset", "ids"),
    [([0, 999, 1000, 1999, 2000], 0, [0, 0, 1, 1, 2]), ([400, 500, 1499, 1500], 500, [-1, 0, 0, 1]), ([-1, -1000, -1001, -500], 0, [-1, -1, -2, -1])],
)
def test_tumbling_ids(spark, times, offset, ids):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t bigint")
    got = df.select("k", tumbling_id(F.col("t"), 1000, offset).alias("w")).orderBy("k").collect()
    assert [r.w for r in got] == ids


@given(st.lists(st.tuples(st.integers(-(10**14), 10**14), st.integers(1, 10**9), st.integers(-(10**9), 10**9)), min_size=1, max_size=30))
def test_tumbling_id_is_floor_division(cases):
    # the arithmetic of tumbling_id without Spark: remainder not below zero, then an exact quotient
    for t, size, offset in cases:
        x = t - offset
        assert (x - x % size) // size == (t - offset) // size


def test_tumbling_ids_of_many_times(spark):
    times = [t * 7919 - 10**9 for t in range(2000)]
    got = spark.createDataFrame([(t,) for t in times], "t bigint").select("t", tumbling_id(F.col("t"), 977, 13).alias("w")).collect()
    assert all(r.w == (r.t - 13) // 977 for r in got)


def test_sliding_gives_all_ids_also_past_the_last_window(spark):
    got = spark.createDataFrame([(3000,)], "t bigint").select(sliding_ids(F.col("t"), 10_000, 4_000).alias("w")).first().w
    assert got == [0, -1, -2]


def test_times_are_cut_towards_zero(spark):
    df = spark.sql("SELECT timestamp_micros(-1500) AS t, 5L AS m")
    assert df.select(millis(df, "t").alias("a"), millis(df, "m").alias("b")).first() == (-1, 5)
    with pytest.raises(SchemaError):
        millis(spark.sql("SELECT 'x' AS t"), "t")


def test_key_hash_vectors(spark):
    df = spark.createDataFrame([("Electronics",), ("Books",), ("é",)], "k string")
    assert [r.h for r in df.select(key_hash([F.col("k")]).alias("h")).collect()] == [-7398031933971204180, -1207725437906743087, -1478210815103739423]

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    two = spark.createDataFrame([("a", 1), (None, 2), ("", None)], "k string, n int")
    want = [fnv(b"\x02a\x00\x021"), fnv(b"\x01\x00\x022"), fnv(b"\x02\x00\x01")]
    assert [r.h for r in two.select(key_hash([F.col("k"), F.col("n")]).alias("h")).collect()] == want
    assert two.select(key_hash([]).alias("h")).first().h == 0


def test_sliding_sums(spark):
    out = Windowed("ts", Sliding(2000, 1000), Reduce("v")).run(frame(spark, [(500, 10.0), (1200, 20.0), (2100, 30.0), (3500, 40.0)]))
    assert rows(out, "window_id", "sum_v") == [(-1, 10.0), (0, 30.0), (1, 50.0), (2, 70.0), (3, 40.0)]
    assert out.columns == ["window_id", "key_hash", "sum_v"]


def test_sessions(spark):
    out = Windowed("ts", Session(1000), Reduce("v")).run(frame(spark, [(100, 10.0), (200, 20.0), (300, 30.0), (5000, 40.0), (5100, 50.0)]))
    assert rows(out, "sum_v", "session_start_ts", "session_end_ts") == [(60.0, 100, 300), (90.0, 5000, 5100)]


def test_session_gap_is_strict_and_crosses_stretches(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in (0, 1000, 2000, 3001)] + [("b", 500, 1.0), (None, 600, 1.0)], "k string, ts bigint, v double")
    for stretch in (1, 2, 4096):
        out = Windowed("ts", Session(1000, stretch), Reduce("v", "count"), ["k"]).run(df)
        assert sorted(((r.k or ""), r.session_start_ts, r.session_end_ts, r.count_v) for r in out.collect()) == [("", 600, 600, 1.0), ("a", 0, 2000, 3.0), ("a", 3001, 3001, 1.0), ("b", 500, 500, 1.0)]


@pytest.mark.parametrize("kind", ["sum", "min", "max", "count", "mean"])
def test_groups_without_values(spark, kind):
    out = Windowed("ts", Tumbling(1000), Reduce("v", kind)).run(frame(spark, [(1, None), (2, None), (1001, 4.0), (1002, None)]))
    got = [r[f"{kind}_v"] for r in out.orderBy("window_id").collect()]
    want = {"sum": [0.0, 4.0], "min": [math.inf, 4.0], "max": [-math.inf, 4.0], "count": [2.0, 2.0], "mean": [math.nan, 4.0]}[kind]
    assert got == pytest.approx(want, nan_ok=True)


def test_null_times_are_left_out(spark):
    out = Windowed("ts", Tumbling(1000), Reduce("v", "count")).run(frame(spark, [(None, 1.0), (1, 1.0)]))
    assert rows(out, "window_id", "count_v") == [(0, 1.0)]


def test_only_doubles_are_aggregated(spark):
    with pytest.raises(SchemaError):
        Windowed("ts", Tumbling(10), Reduce("n")).run(spark.createDataFrame([(1, 2)], "ts bigint, n int"))
    with pytest.raises(ConfigurationError):
        Tumbling(0)
    with pytest.raises(ConfigurationError):
        Sliding(10, 20)
    with pytest.raises(ConfigurationError):
        Reduce("v", "median")


def test_expansion_limit(spark):
    df = frame(spark, [(k, 1.0) for k in range(10)])
    with pytest.raises(ConfigurationError):
        Windowed("ts", Sliding(10, 1), Reduce("v"), max_expansion=99).run(df)
    assert Windowed("ts", Sliding(10, 1), Reduce("v"), max_expansion=100).run(df).count() == 19


def test_partitions_cover_the_keys(spark):
    df = spark.createDataFrame([(f"k{k}", k, 1.0) for k in range(50)], "k string, ts bigint, v double")
    parts = [{r.k for r in Windowed("ts", Tumbling(1000), Reduce("v"), ["k"], partition=(i, 3)).run(df).collect()} for i in range(3)]
    assert set.union(*parts) == {f"k{k}" for k in range(50)} and sum(map(len, parts)) == 50


def in_runs(spark, runs):
    return spark.createDataFrame([(k, t, float(v)) for k, run in enumerate(runs) for t, v in run], "run int, ts bigint, v double")


def test_lateness(spark):
    op = Windowed("ts", Tumbling(2000), Reduce("v", "count"), allowed_lateness_ms=1000)
    out = over_runs(op, in_runs(spark, [[(1000, 1), (2000, 1), (3000, 1)], [(2500, 1)], [(1500, 1)]]), "run")
    assert rows(out.on_time, "run", "window_id") == [(0, 0), (0, 1)]
    assert rows(out.late, "run", "window_id") == [(1, 1)]
    assert rows(out.side_output, "run", "ts") == [(2, 1500)]
    assert (out.total_rows(), out.total_rows_including_late(), out.is_empty()) == (2, 3, False)


def test_lateness_boundary(spark):
    op = Windowed("ts", Tumbling(1000), Reduce("v"), allowed_lateness_ms=1000)
    out = over_runs(op, in_runs(spark, [[(4500, 1), (5000, 1)], [(4000, 2), (3999, 3)]]), "run")
    assert rows(out.late, "window_id", "sum_v") == [(4, 2.0)]
    assert rows(out.side_output, "ts") == [(3999,)]


def test_late_firing_has_the_new_rows_only(spark):
    op = Windowed("ts", Tumbling(2000), Reduce("v"), allowed_lateness_ms=5000)
    out = over_runs(op, in_runs(spark, [[(1000, 10), (1500, 20)], [(1200, 5)]]), "run")
    assert rows(out.on_time, "sum_v") == [(30.0,)] and rows(out.late, "sum_v") == [(5.0,)] and out.side_output.isEmpty()


def test_side_output(spark):
    op = Windowed("ts", Tumbling(1000), Reduce("v"), allowed_lateness_ms=500)
    out = over_runs(op, in_runs(spark, [[(3000, 1)], [(2600, 1), (2499, 1), (2000, 1)]]), "run")
    assert rows(out.on_time.where("run = 1"), "window_id") == [(2,)]
    assert rows(out.side_output, "ts") == [(2000,), (2499,)]


def test_without_lateness_nothing_is_dropped(spark):
    out = over_runs(Windowed("ts", Tumbling(1000), Reduce("v")), in_runs(spark, [[(9000, 1)], [(1, 1)]]), "run")
    assert out.side_output.isEmpty() and out.on_time.count() == 2


def test_watermark_state():
    w = WatermarkState()
    assert w.is_on_time(0) and not w.is_beyond_lateness(0, 0)
    w.advance(5000)
    w.advance(3000)
    assert w.watermark == 5000
    assert w.is_beyond_lateness(3999, 1000) and not w.is_beyond_lateness(4000, 1000)
    assert w.is_late_but_acceptable(4000, 1000) and w.is_on_time(5000)
    assert not w.is_beyond_lateness(0, 5000)  # lateness not below the watermark


def test_process_function(spark):
    def f(c: WindowContext, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": [c.window_id], "start": [c.window_start], "end": [c.window_end], "late": [c.is_late_firing], "mark": [c.watermark], "n": [len(pdf)]})

    schema = "w bigint, start bigint, end bigint, late boolean, mark bigint, n bigint"
    op = Windowed("ts", Tumbling(1000), Process(f, schema), allowed_lateness_ms=1000)
    out = over_runs(op, in_runs(spark, [[(500, 1), (800, 1)], [(600, 1)]]), "run")
    assert rows(out.on_time, "late", "mark", "n") == [(False, 800, 2)] and rows(out.late, "late", "mark", "n") == [(True, 800, 1)]
    moved = Windowed("ts", Sliding(2000, 1000, 100), Process(f, schema)).run(frame(spark, [(1500, 1.0)]))
    assert rows(moved, "w", "start", "end") == [(0, 100, 2100), (1, 1100, 3100)]
    plain = Windowed("ts", Sliding(2000, 1000, 100), Process(f, schema, plain_start=True)).run(frame(spark, [(1500, 1.0)]))
    assert rows(plain, "w", "start", "end") == [(0, 0, 2000), (1, 2000, 4000)]


def test_missing_fields(spark):
    with pytest.raises(ConfigurationError):
        Windowed("ts", Tumbling(10), Reduce("v"), ["nothing"]).run(frame(spark, [(1, 1.0)]))
