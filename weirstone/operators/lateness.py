"""Watermarks, allowed lateness, late firings and the side output.

The watermark is the greatest time of all earlier runs; a run's own disorder never counts. A row is beyond lateness if it is older than the
watermark by more than the allowed lateness (never while the watermark isn't above the lateness itself): such rows go to the side
output. Windows fire in every run that has rows of theirs; a window that an earlier run fired fires late, with the new rows only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirstone.functions.aggregates import Reduce
from weirstone.functions.key_hash import key_hash
from weirstone.operators.windows import ID, MS, Session, Windowed, assigned, processed, session_marks


@dataclass
class WatermarkState:
    """The greatest time seen so far, and what it says of a time."""

    watermark: int | None = None

    def advance(self, ms: int | None) -> None:
        if ms is not None and (self.watermark is None or ms > self.watermark):
            self.watermark = ms

    def is_beyond_lateness(self, ms: int, lateness: int) -> bool:
        return self.watermark is not None and lateness < self.watermark and ms < self.watermark - lateness

    def is_late_but_acceptable(self, ms: int, lateness: int) -> bool:
        return self.watermark is not None and ms < self.watermark and not self.is_beyond_lateness(ms, lateness)

    def is_on_time(self, ms: int) -> bool:
        return self.watermark is None or ms >= self.watermark


def beyond_lateness(ms: Column, watermark: Column, lateness: int) -> Column:
    """The same as a column; false without a watermark."""
    return F.coalesce((F.lit(lateness) < watermark) & (ms < watermark - F.lit(lateness)), F.lit(False))


@dataclass
class WindowResults:
    """What a window operator gives: windows on time, late firings, and the rows that were too late."""

    on_time: DataFrame
    late: DataFrame
    side_output: DataFrame

    def total_rows(self) -> int:
        return self.on_time.count()

    def total_rows_including_late(self) -> int:
        return self.on_time.count() + self.late.count()

    def is_empty(self) -> bool:
        return self.on_time.isEmpty() and self.late.isEmpty()


def _split(op: Windowed, rows: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their run's watermarks before (_before) and after it, kept and dropped."""
    tops = rows.groupBy(run).agg(F.max(MS).alias("_top"))
    order = Window.orderBy(run)  # one row for each run
    marks = tops.select(
        F.col(run).alias("_run"),
        F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_watermark"),
    )
    joined = rows.join(marks, F.col(run) == F.col("_run")).drop("_run")
    gone = F.lit(False) if op.allowed_lateness_ms is None else beyond_lateness(F.col(MS), F.col("_before"), op.allowed_lateness_ms)
    flagged = joined.withColumn("_gone", gone)
    return flagged.where(~F.col("_gone")).drop("_gone", "_before"), flagged.where("_gone").drop("_gone", "_before", "_watermark")


def over_runs(op: Windowed, df: DataFrame, run: str) -> WindowResults:
    """All runs at once: run is a field with each row's run number.

    A window's first firing is the one of the lowest run that has kept rows of it.
    """
    rows = op.prepared(df)
    kept, dropped = _split(op, rows, run)
    fired = Window.partitionBy(*op.keyed_by, ID).orderBy(run)
    side = dropped.drop(MS)
    if isinstance(op.function, Reduce):
        found = op.reduced(kept, [run]).withColumn("_late", F.row_number().over(fired) > 1)
        own = [c for c in found.columns if c not in (run, *op.keyed_by, ID, "_late")]
        out = found.select(run, ID, key_hash([F.col(k) for k in op.keyed_by]).alias("key_hash"), *op.keyed_by, *own, "_late")
        return WindowResults(out.where(~F.col("_late")).drop("_late"), out.where("_late").drop("_late"), side)
    whole = session_marks(kept, op.window, [run, *op.keyed_by]) if isinstance(op.window, Session) else assigned(kept, op.window)
    firings = whole.select(run, *op.keyed_by, ID).distinct().withColumn("_late", F.row_number().over(fired) > 1)
    renamed = firings.select(F.col(run).alias("_r"), F.col(ID).alias("_w"), *(F.col(k).alias(f"_k_{k}") for k in op.keyed_by), "_late")
    same = (F.col(run) == F.col("_r")) & (F.col(ID) == F.col("_w"))
    for k in op.keyed_by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    flagged = whole.join(renamed, same).drop("_r", "_w", *(f"_k_{k}" for k in op.keyed_by))
    return WindowResults(processed(op, flagged.where(~F.col("_late")), [run]), processed(op, flagged.where("_late"), [run]), side)
