"""Durable state of each window and key: counts and bounds that are merged from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.errors import ConfigurationError, SchemaError
from weirstone.functions.aggregates import Reduce, finish
from weirstone.functions.key_hash import key_hash
from weirstone.operators.windows import ID, MS, Session, Windowed, assigned, session_marks
from weirstone.types import Component, parse_schema

#: The fields of the state rows.
FIELDS = [
    ("version", "uint32", True),
    ("source_component", "utf8", False),
    ("window_id", "int64", False),
    ("key_hash", "int64", False),
    ("count", "int64", False),
    ("sum_f64", "float64", True),
    ("min_f64", "float64", True),
    ("max_f64", "float64", True),
    ("session_start_ts", "int64", True),
    ("session_end_ts", "int64", True),
    ("finalized_at_watermark", "int64", True),
]
VERSION = 1
ACCUMULATOR = Component("WindowAccumulator", parse_schema({"name": n, "type": t, "nullable": null} for n, t, null in FIELDS), VERSION)
KEY = ["source_component", "window_id", "key_hash"]


def accumulated(op: Windowed, df: DataFrame, watermark: int | None = None) -> DataFrame:
    """State rows of one run's rows."""
    if not isinstance(op.function, Reduce):
        raise ConfigurationError("only reduced windows have accumulators")
    rows = op.prepared(df)
    session = isinstance(op.window, Session)
    whole = session_marks(rows, op.window, op.keyed_by) if session else assigned(rows, op.window)
    value = F.col(op.function.field)
    found = whole.groupBy(*op.keyed_by, ID).agg(F.count(value).alias("count"), F.sum(value).alias("sum_f64"), F.min(value).alias("min_f64"), F.max(value).alias("max_f64"), F.min(MS).alias("_from"), F.max(MS).alias("_to"))
    none = F.lit(None).cast("bigint")
    return found.select(
        F.lit(VERSION).cast("bigint").alias("version"),
        F.lit(op.source).alias("source_component"),
        ID,
        key_hash([F.col(k) for k in op.keyed_by]).alias("key_hash"),
        "count",
        "sum_f64",
        "min_f64",
        "max_f64",
        (F.col("_from") if session else none).alias("session_start_ts"),
        (F.col("_to") if session else none).alias("session_end_ts"),
        F.lit(watermark).cast("bigint").alias("finalized_at_watermark"),
    )


def merge(state: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """State after new rows: "merge" adds them up, "latest" lets a new row take the old one's place."""
    both = state.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    if mode == "latest":
        last = both.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in state.columns if c not in KEY)), "_age").alias("_s"))
        return last.select(*(F.col(c) if c in KEY else F.col(f"_s.{c}").alias(c) for c in state.columns))
    if mode != "merge":
        raise ConfigurationError(f"unknown mode {mode!r}")
    kinds = {"version": F.max, "count": F.sum, "sum_f64": F.sum, "min_f64": F.min, "max_f64": F.max, "session_start_ts": F.min, "session_end_ts": F.max, "finalized_at_watermark": F.max}
    return both.groupBy(*KEY).agg(*(f(c).alias(c) for c, f in kinds.items())).select(*state.columns)


def value(kind: str) -> Column:
    """A window aggregate from state rows; count counts values here, as state rows keep no null ones."""
    return finish(kind, {"rows": F.col("count"), "values": F.nullif(F.col("count"), F.lit(0)), "sum": F.col("sum_f64"), "min": F.col("min_f64"), "max": F.col("max_f64")})


def migrate_to_current(df: DataFrame, version: int | None) -> DataFrame:
    """State of an older version as today's; state without a version is version 1, newer state is refused."""
    if version is not None and version > VERSION:
        raise SchemaError(f"state of version {version} is newer than {VERSION}")
    return ACCUMULATOR.check(df)
