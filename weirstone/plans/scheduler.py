"""Several pipelines: what runs after what, who goes first, who is skipped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from weirstone.errors import SchedulerError
from weirstone.plans.pipeline import Pipeline, RunStats

ORDER, DATA = "order", "data"


@dataclass(frozen=True)
class After:
    """An upstream pipeline. With data, the downstream one is skipped if the upstream made no rows (net) or was skipped itself."""

    pipeline: str
    kind: str = ORDER


@dataclass(frozen=True)
class PipelineOptions:
    after: tuple[After, ...] = ()
    #: Lower goes first within a stage; equal priorities keep the order in which pipelines were added.
    priority: int = 0
    #: Skips the pipeline while true.
    backpressure: Callable[[], bool] | None = None


@dataclass(frozen=True)
class Tick:
    """What a round did: statistics of those that ran, in order, and those that were skipped with the reason."""

    ran: dict[str, RunStats]
    skipped: dict[str, str]


class Scheduler:
    def __init__(self) -> None:
        self.pipelines: dict[str, tuple[Pipeline, PipelineOptions]] = {}

    def add(self, pipeline: Pipeline, options: PipelineOptions | None = None) -> Scheduler:
        if pipeline.name in self.pipelines:
            raise SchedulerError(f"there is a pipeline {pipeline.name!r} already")
        self.pipelines[pipeline.name] = (pipeline, options or PipelineOptions())
        return self

    def get(self, name: str) -> Pipeline:
        try:
            return self.pipelines[name][0]
        except KeyError:
            raise SchedulerError(f"no pipeline {name!r}") from None

    def order(self) -> list[list[str]]:
        """Stages of pipelines; each stage by priority."""
        waits: dict[str, set[str]] = {}
        for name, (_, o) in self.pipelines.items():
            waits[name] = {a.pipeline for a in o.after}
            if unknown := waits[name] - self.pipelines.keys():
                raise SchedulerError(f"{name} comes after unknown pipelines: {', '.join(sorted(unknown))}")
        out: list[list[str]] = []
        while waits:
            ready = [n for n, w in waits.items() if not w]
            if not ready:
                raise SchedulerError(f"a cycle among {', '.join(waits)}")
            out.append(sorted(ready, key=lambda n: self.pipelines[n][1].priority))
            for n in ready:
                del waits[n]
            for w in waits.values():
                w.difference_update(ready)
        return out

    def tick(self) -> Tick:
        """One round over all pipelines. Rows are counted only where a data dependency asks for them."""
        watched = {a.pipeline for _, o in self.pipelines.values() for a in o.after if a.kind == DATA}
        ran: dict[str, RunStats] = {}
        skipped: dict[str, str] = {}
        for name in (n for stage in self.order() for n in stage):
            pipeline, options = self.pipelines[name]
            dry = [a.pipeline for a in options.after if a.kind == DATA and (a.pipeline in skipped or not ran[a.pipeline].rows_produced)]
            if dry:
                skipped[name] = f"no rows from {', '.join(dry)}"
            elif options.backpressure is not None and options.backpressure():
                skipped[name] = "backpressure"
            else:
                ran[name] = pipeline.run_with_io(count=name in watched)
        return Tick(ran, skipped)
