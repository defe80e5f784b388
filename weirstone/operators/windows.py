"""Event-time windows over keyed rows: which windows a row is in, and the rows of each window reduced or processed.

Rows without a time are left out. Tumbling and sliding windows have integer ids; a session's id is its first time, which stays the
same whatever other rows there are. Keys are grouped by value, and their hash is added to the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import ConfigurationError
from weirstone.functions.aggregates import Reduce, finish, merged, partials
from weirstone.functions.event_time import millis, sliding_ids, tumbling_id
from weirstone.functions.key_hash import key_hash

MS, ID = "_ms", "window_id"


@dataclass(frozen=True)
class Tumbling:
    """Windows side by side, each size_ms long, moved by offset_ms from the epoch."""

    size_ms: int
    offset_ms: int = 0

    def __post_init__(self) -> None:
        if self.size_ms <= 0:
            raise ConfigurationError("a tumbling window's size must be above 0")

    def start(self, window_id: Column) -> Column:
        return window_id * self.size_ms + self.offset_ms

    @property
    def span_ms(self) -> int:
        return self.size_ms


@dataclass(frozen=True)
class Sliding:
    """Windows size_ms long that begin every slide_ms. Each row is in ceil(size / slide) of them, also where size is no multiple of
    slide and the row lies past the last one's end."""

    size_ms: int
    slide_ms: int
    offset_ms: int = 0

    def __post_init__(self) -> None:
        if self.size_ms <= 0 or not 0 < self.slide_ms <= self.size_ms:
            raise ConfigurationError("a sliding window needs 0 < slide <= size")

    def start(self, window_id: Column) -> Column:
        return window_id * self.slide_ms + self.offset_ms

    @property
    def copies(self) -> int:
        return math.ceil(self.size_ms / self.slide_ms)

    @property
    def span_ms(self) -> int:
        return self.size_ms


@dataclass(frozen=True)
class Session:
    """Rows of a key of which none is more than gap_ms after the one before. A gap of just gap_ms doesn't end a session."""

    gap_ms: int
    #: Time is cut into stretches of so many gaps; a key's stretches are put into sessions apart and then joined.
    gaps_in_stretch: int = 4_096

    def __post_init__(self) -> None:
        if self.gap_ms < 0:
            raise ConfigurationError("a session's gap must not be below 0")


Spec = Tumbling | Sliding | Session


@dataclass(frozen=True)
class WindowContext:
    """What a process function is told of its window."""

    window_id: int
    window_start: int
    window_end: int
    is_late_firing: bool
    watermark: int | None


@dataclass(frozen=True)
class Process:
    """A function of the context and all rows (a pandas frame in the order of time) of a window and key; schema is that of its result."""

    function: Callable[[WindowContext, pd.DataFrame], pd.DataFrame]
    schema: str | T.StructType
    #: True gives window_start = id * size whatever the offset or slide, for programs that rely on it.
    plain_start: bool = False


def timed(df: DataFrame, time_field: str) -> DataFrame:
    """Rows that have a time, with it as _ms."""
    return df.withColumn(MS, millis(df, time_field)).where(F.col(MS).isNotNull())


def assigned(rows: DataFrame, spec: Tumbling | Sliding) -> DataFrame:
    """The rows of timed() with window_id, once for each window."""
    if isinstance(spec, Tumbling):
        return rows.withColumn(ID, tumbling_id(F.col(MS), spec.size_ms, spec.offset_ms))
    return rows.withColumn(ID, F.explode(sliding_ids(F.col(MS), spec.size_ms, spec.slide_ms, spec.offset_ms)))


def session_marks(rows: DataFrame, spec: Session, keys: Sequence[str]) -> DataFrame:
    """The rows of timed() with window_id, the first time of their session.

    Each key's rows are ordered in stretches of time, so a key that most rows have is spread over tasks; then the stretches'
    first and last times, a few rows for each key, tell which sessions go on into the next stretch.
    """
    stretch = max(1, spec.gap_ms) * spec.gaps_in_stretch
    cut = rows.withColumn("_stretch", tumbling_id(F.col(MS), stretch))
    within = Window.partitionBy(*keys, "_stretch").orderBy(MS)
    begun = F.when(F.col(MS) - F.lag(MS).over(within) <= spec.gap_ms, None).otherwise(F.col(MS))
    local = cut.withColumn("_begun", begun).withColumn("_local", F.last("_begun", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = local.groupBy(*keys, "_local").agg(F.max(MS).alias("_last"))
    over = Window.partitionBy(*keys).orderBy("_local")
    first = F.when(F.col("_local") - F.lag("_last").over(over) <= spec.gap_ms, None).otherwise(F.col("_local"))
    heads = pieces.withColumn("_first", first).withColumn(ID, F.last("_first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    renamed = heads.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_local").alias("_piece"), ID)
    same = F.col("_local") == F.col("_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return local.join(renamed, same).drop("_stretch", "_begun", "_local", "_piece", *(f"_k_{k}" for k in keys))


def sessions(rows: DataFrame, spec: Session, keys: Sequence[str], reduce: Reduce, more: Sequence[str] = ()) -> DataFrame:
    """Reduced sessions without going back to the rows: stretches are reduced to pieces and the pieces joined."""
    stretch = max(1, spec.gap_ms) * spec.gaps_in_stretch
    by = [*more, *keys]
    cut = rows.withColumn("_stretch", tumbling_id(F.col(MS), stretch))
    within = Window.partitionBy(*by, "_stretch").orderBy(MS)
    begun = F.when(F.col(MS) - F.lag(MS).over(within) <= spec.gap_ms, None).otherwise(F.col(MS))
    local = cut.withColumn("_begun", begun).withColumn("_local", F.last("_begun", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = local.groupBy(*by, "_stretch", "_local").agg(F.max(MS).alias("_last"), *(c.alias(n) for n, c in partials(F.col(reduce.field)).items()))
    over = Window.partitionBy(*by).orderBy("_local")
    first = F.when(F.col("_local") - F.lag("_last").over(over) <= spec.gap_ms, None).otherwise(F.col("_local"))
    heads = pieces.withColumn("_first", first).withColumn(ID, F.last("_first", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    whole = heads.groupBy(*by, ID).agg(F.max("_last").alias("session_end_ts"), *(c.alias(n) for n, c in merged().items()))
    value = finish(reduce.kind, {n: F.col(n) for n in merged()})
    return whole.select(*by, ID, value.alias(reduce.name), F.col(ID).alias("session_start_ts"), "session_end_ts")


@dataclass(frozen=True)
class Windowed:
    """A declared window operator: what to read, how to key and cut it, and what to do with each window."""

    time_field: str
    window: Spec
    function: Reduce | Process
    keyed_by: Sequence[str] = ()
    #: None: no row is ever late. Otherwise rows older than the watermark of earlier runs by more than this are put aside.
    allowed_lateness_ms: int | None = None
    source: str = ""
    #: Most rows that a sliding window may make of its input; None: no limit, as they are never held at once.
    max_expansion: int | None = None
    #: Keep rows of one part of the key space: (number, of how many).
    partition: tuple[int, int] | None = None

    def __post_init__(self) -> None:
        if self.allowed_lateness_ms is not None and self.allowed_lateness_ms < 0:
            raise ConfigurationError("allowed lateness must not be below 0")
        if self.partition is not None and not 0 <= self.partition[0] < self.partition[1]:
            raise ConfigurationError("a partition is (number, of how many)")

    def prepared(self, df: DataFrame) -> DataFrame:
        """Rows with a time, of this partition."""
        if isinstance(self.function, Reduce):
            self.function.check(df)
        missing = [k for k in (*self.keyed_by, self.time_field) if k not in df.columns]
        if missing:
            raise ConfigurationError(f"no field {', '.join(missing)} in the source")
        rows = timed(df, self.time_field)
        if self.partition is not None and self.partition[1] > 1 and self.keyed_by:
            rows = rows.where(F.pmod(key_hash([F.col(k) for k in self.keyed_by]), F.lit(self.partition[1])) == self.partition[0])
        if self.max_expansion is not None and isinstance(self.window, Sliding) and rows.count() * self.window.copies > self.max_expansion:
            raise ConfigurationError(f"the sliding window makes more than {self.max_expansion} rows")
        return rows

    def reduced(self, rows: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        """Columns more, keys, window_id and the value (sessions: and their bounds) of rows that prepared() made."""
        assert isinstance(self.function, Reduce)
        if isinstance(self.window, Session):
            return sessions(rows, self.window, self.keyed_by, self.function, more)
        return assigned(rows, self.window).groupBy(*more, *self.keyed_by, ID).agg(self.function.column())

    def run(self, df: DataFrame) -> DataFrame:
        """One run over all rows: keys, window_id, key_hash and the value of each window; a process function's own columns."""
        rows = self.prepared(df)
        if isinstance(self.function, Process):
            whole = session_marks(rows, self.window, self.keyed_by) if isinstance(self.window, Session) else assigned(rows, self.window)
            return processed(self, whole.withColumn("_late", F.lit(False)).withColumn("_watermark", F.lit(None).cast("bigint")), [])
        out = self.reduced(rows)
        own = [c for c in out.columns if c not in (*self.keyed_by, ID)]
        return out.select(ID, key_hash([F.col(k) for k in self.keyed_by]).alias("key_hash"), *self.keyed_by, *own)


def processed(op: Windowed, rows: DataFrame, more: Sequence[str]) -> DataFrame:
    """The process function over each (more, keys, window_id) of rows that also have _late and _watermark."""
    function, spec = op.function, op.window
    assert isinstance(function, Process)
    inner = [c for c in rows.columns if c not in (MS, "_late", "_watermark", ID, *more)]

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(MS, kind="stable")
        w = int(pdf[ID].iloc[0])
        if isinstance(spec, Session):
            start, end = (0, 0) if function.plain_start else (int(pdf[MS].min()), int(pdf[MS].max()))
        else:
            step, offset = (spec.slide_ms if isinstance(spec, Sliding) else spec.size_ms), spec.offset_ms
            start = w * spec.size_ms if function.plain_start else w * step + offset
            end = start + spec.size_ms
        mark = pdf["_watermark"].iloc[0]
        context = WindowContext(w, start, end, bool(pdf["_late"].iloc[0]), None if pd.isna(mark) else int(mark))
        return function.function(context, pdf[inner].reset_index(drop=True))

    return rows.groupBy(*more, *op.keyed_by, ID).applyInPandas(call, function.schema)
