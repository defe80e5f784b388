"""Event-time windows over the event stream, in batch form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.functions.aggregates import KINDS, Reduce
from weirstone.functions.event_time import millis
from weirstone.functions.key_hash import key_hash
from weirstone.operators import accumulator
from weirstone.operators.lateness import over_runs
from weirstone.operators.windows import Process, Session, Sliding, Spec, Tumbling, WindowContext, Windowed
from weirstone.plans.tables import DAY, HOUR, events, events_in_runs

#: The hash of a key of ASCII text in DuckDB.
FNV = (
    "(SELECT CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END FROM (SELECT list_reduce(list_concat([14695981039346656037::HUGEINT, 2::HUGEINT], "
    "list_transform(string_split({key}, ''), lambda c: ascii(c)::HUGEINT)), lambda h, x: (xor(h, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h))::BIGINT"
)
FIRST = "(epoch_us(ts) // 1000)"


def floor_id(ms: str, size: int, offset: int = 0) -> str:
    """A tumbling window's number in DuckDB."""
    x = f"({ms} - {offset})"
    return f"CAST(({x} - ((({x}) % {size}) + {size}) % {size}) // {size} AS BIGINT)"


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _tumbling(kind: str):
    op = Windowed("ts", Tumbling(6 * HOUR), Reduce("value", kind), ["event_type"])

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(op.run(events(spark, folder)), f"{kind}_value", places=9 if kind == "mean" else 4)

    value = {"sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(*) AS DOUBLE)", "mean": "avg(value)"}[kind]
    oracle = f"SELECT {floor_id(FIRST, 6 * HOUR)} AS window_id, {FNV.format(key='event_type')} AS key_hash, event_type, round({value}, {9 if kind == "mean" else 4}) AS {kind}_value FROM events WHERE ts IS NOT NULL GROUP BY 1, event_type"
    return query, oracle


def tumbling_global(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Windowed("ts", Tumbling(DAY), Reduce("value")).run(events(spark, folder)), "sum_value")


def tumbling_offset(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(Windowed("ts", Tumbling(6 * HOUR, 90 * 60_000), Reduce("value"), ["user_id"]).run(events(spark, folder)).drop("key_hash"), "sum_value")


def with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Events of which some have no value, some users none at all, and some no time."""
    e = events(spark, folder)
    return e.withColumn("value", F.when((F.col("user_id") % 7 == 0) | (F.col("event_id") % 5 == 0), None).otherwise(F.col("value"))).withColumn("ts", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts")))


NULLED = "(SELECT event_id, user_id, event_type, CASE WHEN user_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM events)"


def tumbling_null_agg(spark: SparkSession, folder: str) -> DataFrame:
    """All five aggregates where groups have nulls or nothing else, as text where they aren't finite."""
    rows = with_nulls(spark, folder)
    out = None
    for kind in KINDS:
        own = Windowed("ts", Tumbling(5 * DAY), Reduce("value", kind), ["user_id"]).run(rows).select("window_id", "user_id", F.lit(kind).alias("kind"), F.round(F.col(f"{kind}_value"), 9).alias("v"))
        out = own if out is None else out.unionByName(own)
    text = F.when(F.isnan("v"), "NaN").when(F.col("v") == float("inf"), "+Inf").when(F.col("v") == float("-inf"), "-Inf").otherwise("finite")
    return out.select("window_id", "user_id", "kind", text.alias("class"), F.when(text == "finite", F.col("v")).alias("finite_value"))


TUMBLING_NULL_AGG = f"""
WITH g AS (SELECT {floor_id(FIRST, 5 * DAY)} AS window_id, user_id, count(value) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, count(*) AS c FROM {NULLED} WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT window_id, user_id, 'sum' AS kind, 'finite' AS class, round(coalesce(s, 0.0), 9) AS finite_value FROM g
UNION ALL SELECT window_id, user_id, 'min', CASE WHEN n = 0 THEN '+Inf' ELSE 'finite' END, round(lo, 9) FROM g
UNION ALL SELECT window_id, user_id, 'max', CASE WHEN n = 0 THEN '-Inf' ELSE 'finite' END, round(hi, 9) FROM g
UNION ALL SELECT window_id, user_id, 'count', 'finite', CAST(c AS DOUBLE) FROM g
UNION ALL SELECT window_id, user_id, 'mean', CASE WHEN n = 0 THEN 'NaN' ELSE 'finite' END, round(s / nullif(n, 0), 9) FROM g
"""


def _sliding(size: int, slide: int, offset: int = 0):
    op = Windowed("ts", Sliding(size, slide, offset), Reduce("value"), ["event_type"])

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(op.run(events(spark, folder)).drop("key_hash"), "sum_value")

    own = floor_id(f"({FIRST} - j * {slide})", slide, offset)
    oracle = f"SELECT {own} AS window_id, event_type, round(sum(value), 4) AS sum_value FROM events, range(0, {-(-size // slide)}) AS t(j) WHERE ts IS NOT NULL GROUP BY 1, event_type"
    return query, oracle


def session_sum(spark: SparkSession, folder: str) -> DataFrame:
    op = Windowed("ts", Session(2 * HOUR, gaps_in_stretch=16), Reduce("value"), ["user_id"])
    return rounded(op.run(events(spark, folder)).drop("key_hash"), "sum_value")


SESSION_SUM = f"""
WITH a AS (SELECT user_id, {FIRST} AS ms, value FROM events WHERE ts IS NOT NULL),
b AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= {2 * HOUR} THEN 0 ELSE 1 END AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms) AS k FROM b)
SELECT min(ms) AS window_id, user_id, round(sum(value), 4) AS sum_value, min(ms) AS session_start_ts, max(ms) AS session_end_ts FROM c GROUP BY user_id, k
"""

LATE = Windowed("ts", Tumbling(6 * HOUR), Reduce("value"), ["event_type"], allowed_lateness_ms=2 * DAY)
LATE_PARTS = f"""
WITH e AS (SELECT *, {FIRST} AS ms, CAST((event_id * 7919) % 13 AS BIGINT) AS run FROM events WHERE ts IS NOT NULL),
r AS (SELECT run, max(max(ms)) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM e GROUP BY run),
m AS (SELECT e.*, coalesce({2 * DAY} < wm AND ms < wm - {2 * DAY}, false) AS gone FROM e JOIN r USING (run)),
g AS (SELECT run, {floor_id("ms", 6 * HOUR)} AS window_id, event_type, round(sum(value), 4) AS sum_value FROM m WHERE NOT gone GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY window_id, event_type ORDER BY run) > 1 AS late FROM g)
"""


def late_on_time(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(over_runs(LATE, events_in_runs(spark, folder), "run").on_time.drop("key_hash"), "sum_value")


def late_refire(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(over_runs(LATE, events_in_runs(spark, folder), "run").late.drop("key_hash"), "sum_value")


def late_side_output(spark: SparkSession, folder: str) -> DataFrame:
    return over_runs(LATE, events_in_runs(spark, folder), "run").side_output.select("run", "event_id", "event_type", F.round("value", 4).alias("value"))


def _annotate(context: WindowContext, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "event_type": [rows["event_type"].iloc[0]],
            "window_start": [context.window_start],
            "window_end": [context.window_end],
            "rows": [len(rows)],
            "first_event": [int(rows["event_id"].iloc[0])],
            "spread": [round(float(rows["value"].max() - rows["value"].min()), 4)],
        }
    )


def process_window_annotate(spark: SparkSession, folder: str) -> DataFrame:
    op = Windowed("ts", Tumbling(DAY, HOUR), Process(_annotate, "event_type string, window_start bigint, window_end bigint, rows bigint, first_event bigint, spread double"), ["event_type"])
    return op.run(events(spark, folder).select("event_id", "ts", "event_type", "value"))


PROCESS_WINDOW = f"""
WITH a AS (SELECT *, {FIRST} AS ms, {floor_id(FIRST, DAY, HOUR)} AS w FROM events WHERE ts IS NOT NULL)
SELECT event_type, w * {DAY} + {HOUR} AS window_start, (w + 1) * {DAY} + {HOUR} AS window_end, count(*) AS rows, arg_min(event_id, ms) AS first_event, round(max(value) - min(value), 4) AS spread
FROM a GROUP BY event_type, w
"""


def hashed_keys(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", key_hash([F.col("event_type")]).alias("key_hash"), "n")


def key_partition_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Partition 1 of 3 of the keys."""
    op = Windowed("ts", Tumbling(DAY), Reduce("value", "count"), ["event_type"], partition=(1, 3))
    return op.run(events(spark, folder)).select("window_id", "event_type", "count_value")


KEY_PARTITION = f"SELECT {floor_id(FIRST, DAY)} AS window_id, event_type, CAST(count(*) AS DOUBLE) AS count_value FROM events WHERE ts IS NOT NULL AND (({FNV.format(key='event_type')} % 3) + 3) % 3 = 1 GROUP BY 1, 2"


def null_time_dropped(spark: SparkSession, folder: str) -> DataFrame:
    return Windowed("ts", Tumbling(DAY), Reduce("value", "count")).run(with_nulls(spark, folder)).select("window_id", "count_value")


NULL_TIME = f"SELECT {floor_id(FIRST, DAY)} AS window_id, CAST(count(*) AS DOUBLE) AS count_value FROM {NULLED} WHERE ts IS NOT NULL GROUP BY 1"


def accumulator_merge(spark: SparkSession, folder: str) -> DataFrame:
    """State of three runs, merged one after the other."""
    op = Windowed("ts", Tumbling(DAY), Reduce("value"), ["event_type"], source="events")
    rows = events_in_runs(spark, folder, 3)
    state = accumulator.accumulated(op, rows.where("run = 0"))
    for run in (1, 2):
        state = accumulator.merge(state, accumulator.accumulated(op, rows.where(F.col("run") == run)))
    return state.select("window_id", "key_hash", "count", F.round("sum_f64", 4).alias("sum_f64"), F.round("min_f64", 4).alias("min_f64"), F.round("max_f64", 4).alias("max_f64"))


ACCUMULATOR = f"""
SELECT {floor_id(FIRST, DAY)} AS window_id, {FNV.format(key='event_type')} AS key_hash, count(value) AS count, round(sum(value), 4) AS sum_f64, round(min(value), 4) AS min_f64, round(max(value), 4) AS max_f64
FROM events WHERE ts IS NOT NULL GROUP BY 1, event_type
"""

QUERIES = {
    "tumbling_global": tumbling_global,
    "tumbling_offset": tumbling_offset,
    "tumbling_null_agg": tumbling_null_agg,
    "session_sum": session_sum,
    "late_on_time": late_on_time,
    "late_refire": late_refire,
    "late_side_output": late_side_output,
    "process_window_annotate": process_window_annotate,
    "key_hash": hashed_keys,
    "key_partition_filter": key_partition_filter,
    "null_time_dropped": null_time_dropped,
    "accumulator_merge": accumulator_merge,
}
ORACLES = {
    "tumbling_global": f"SELECT {floor_id(FIRST, DAY)} AS window_id, CAST(0 AS BIGINT) AS key_hash, round(sum(value), 4) AS sum_value FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "tumbling_offset": f"SELECT {floor_id(FIRST, 6 * HOUR, 90 * 60_000)} AS window_id, user_id, round(sum(value), 4) AS sum_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "tumbling_null_agg": TUMBLING_NULL_AGG,
    "session_sum": SESSION_SUM,
    "late_on_time": LATE_PARTS + "SELECT run, window_id, event_type, sum_value FROM f WHERE NOT late",
    "late_refire": LATE_PARTS + "SELECT run, window_id, event_type, sum_value FROM f WHERE late",
    "late_side_output": LATE_PARTS + "SELECT run, event_id, event_type, round(value, 4) AS value FROM m WHERE gone",
    "process_window_annotate": PROCESS_WINDOW,
    "key_hash": f"SELECT event_type, {FNV.format(key='event_type')} AS key_hash, count(*) AS n FROM events GROUP BY event_type",
    "key_partition_filter": KEY_PARTITION,
    "null_time_dropped": NULL_TIME,
    "accumulator_merge": ACCUMULATOR,
}
SPECS: dict[str, Spec] = {"sliding_sum": Sliding(HOUR * 12, HOUR * 3), "sliding_nonmultiple": Sliding(HOUR * 10, HOUR * 4, HOUR)}
for _kind in KINDS:
    QUERIES[f"tumbling_{_kind}_keyed"], ORACLES[f"tumbling_{_kind}_keyed"] = _tumbling(_kind)
for _name, _spec in SPECS.items():
    QUERIES[_name], ORACLES[_name] = _sliding(_spec.size_ms, _spec.slide_ms, _spec.offset_ms)
