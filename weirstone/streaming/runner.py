"""How a pipeline is driven: once, at an interval, continuously, or by a stream's micro-batches."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weirstone.errors import ConfigurationError, EngineError
from weirstone.plans.pipeline import Pipeline

#: The pause between runs in continuous mode, and after an error of a stream's source.
CONTINUOUS_PAUSE_S, ERROR_PAUSE_S = 0.1, 0.01
CONTINUOUS, ONE_SHOT, INTERVAL, STREAM = "continuous", "one_shot", "interval", "stream"


@dataclass
class Counters:
    """What a driver loop has done so far."""

    runs: int = 0
    source_errors: int = 0
    runtime_errors: int = 0
    sink_errors: int = 0
    rows: int = 0
    last_error: str = ""


@dataclass
class Driver:
    """Runs a pipeline until stopped. Errors are counted and the loop goes on; sinks are written also after a failed run."""

    pipeline: Pipeline
    mode: str = CONTINUOUS
    interval_ms: int = 0
    counters: Counters = field(default_factory=Counters)
    stop: threading.Event = field(default_factory=threading.Event)

    def __post_init__(self) -> None:
        if self.mode not in (CONTINUOUS, ONE_SHOT, INTERVAL, STREAM):
            raise ConfigurationError(f"unknown run mode {self.mode!r}")
        if self.mode == INTERVAL and self.interval_ms <= 0:
            raise ConfigurationError("interval mode needs interval_ms above 0")

    def once(self) -> None:
        ws, c = self.pipeline.workspace, self.counters
        for component, read in self.pipeline.sources:
            try:
                ws.replace(component, read(ws))
            except Exception as e:
                c.source_errors, c.last_error = c.source_errors + 1, str(e)
        try:
            self.pipeline.run()
            c.runs += 1
        except Exception as e:
            c.runtime_errors, c.last_error = c.runtime_errors + 1, str(e)
        for component, write in self.pipeline.sinks:
            try:
                write(ws[component])
            except Exception as e:
                c.sink_errors, c.last_error = c.sink_errors + 1, str(e)

    def run(self, most_runs: int | None = None) -> Counters:
        """Loop until stop is set, or once in one-shot mode."""
        if self.mode == STREAM:
            raise ConfigurationError("stream mode is started with stream()")
        pause = self.interval_ms / 1000 if self.mode == INTERVAL else CONTINUOUS_PAUSE_S
        n = 0
        while not self.stop.is_set():
            began = time.monotonic()
            self.once()
            n += 1
            if self.mode == ONE_SHOT or n == most_runs:
                break
            self.stop.wait(max(0.0, pause - (time.monotonic() - began) if self.mode == INTERVAL else pause))
        return self.counters


def stream(pipeline: Pipeline, source: DataFrame, checkpoint: str, counters: Counters | None = None, drop_failed: bool = False, **trigger: object) -> StreamingQuery:
    """Each micro-batch as one run over a workspace that holds it alone; its sinks are written before the batch is done.

    A batch whose run fails is counted and fails the query, so that it is tried again from the checkpoint. With drop_failed a batch that the pipeline's own
    systems reject (an EngineError) is dropped instead, as a bad item must not hold up those after it; other errors, a lost executor's say, still fail the query.
    """
    if len(pipeline.sources) != 1:
        raise ConfigurationError(f"{pipeline.name}: stream mode needs exactly one source")
    own = counters if counters is not None else Counters()

    def batch(df: DataFrame, number: int) -> None:
        try:
            pipeline.run_items([df])
            own.runs += 1
        except Exception as e:
            own.runtime_errors, own.last_error = own.runtime_errors + 1, str(e)
            if not drop_failed or not isinstance(e, EngineError):
                raise
            time.sleep(ERROR_PAUSE_S)

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stateful(call: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], source: DataFrame, state_folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **trigger: object) -> StreamingQuery:
    """Micro-batches with a state that goes from one to the next: call(rows, state before) gives (rows out, state after).

    The state of batch b is read from version b - 1 and written as version b, so that a replay starts from the same state.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        path = f"{state_folder}/version="
        prior = spark.read.parquet(f"{path}{number - 1}") if number else None
        out, after = call(df, prior)
        after.write.mode("overwrite").parquet(f"{path}{number}")
        sink(out, number)

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(**trigger) if trigger else writer).start()
