"""A pipeline: systems over a workspace, with sources before and sinks after.

A stage's column systems become one projection for each component, and Catalyst folds the stages into one plan; nothing runs
before a sink, a count or a system of the user's own asks for rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from weirstone.errors import ConfigurationError, EngineError, SystemExecutionError
from weirstone.operators.workspace import Workspace
from weirstone.plans import planner
from weirstone.plans.meta import Access, System

Reader = Callable[[Workspace], DataFrame]
Writer = Callable[[DataFrame], None]


@dataclass(frozen=True)
class RunStats:
    """What a run did. rows_produced is the net change of live rows; None where it wasn't counted."""

    systems_run: int
    retries: int
    seconds: float
    rows_produced: int | None = None


class Pipeline:
    def __init__(self, name: str, workspace: Workspace):
        self.name, self.workspace = name, workspace
        self.systems: list[System] = []
        self.sources: list[tuple[str, Reader]] = []
        self.sinks: list[tuple[str, Writer]] = []
        self._plan: list[list[int]] | None = None
        self.last_stats: RunStats | None = None

    # -- building

    def add(self, *systems: System) -> Pipeline:
        self.systems.extend(systems)
        self._plan = None
        return self

    def add_columns(self, access: Access, columns: Callable[[Workspace], dict], **more: Any) -> Pipeline:
        return self.add(System(access, columns=columns, **more))

    def add_step(self, access: Access, run: Callable[[Workspace], None], **more: Any) -> Pipeline:
        return self.add(System(access, run=run, **more))

    def add_source(self, component: str, read: Reader) -> Pipeline:
        self.sources.append((component, read))
        return self

    def add_sink(self, component: str, write: Writer) -> Pipeline:
        self.sinks.append((component, write))
        return self

    # -- planning

    def stages(self) -> list[list[str]]:
        return [[self.systems[i].name for i in s] for s in self._stages()]

    def stage_count(self) -> int:
        return len(self._stages())

    def validate(self) -> None:
        self._stages()
        for c, _ in (*self.sources, *self.sinks):
            if c not in self.workspace.components:
                raise ConfigurationError(f"{self.name}: no component {c!r} for a source or sink")

    def _stages(self) -> list[list[int]]:
        if self._plan is None:
            fields = {n: c.schema.names for n, c in self.workspace.components.items()}
            self._plan = planner.stages([s.access for s in self.systems], fields)
        return self._plan

    # -- running

    def run(self, count: bool = False, checkpoint_every: int = 0) -> RunStats:
        """Run all stages. With count the live rows are counted before and after, which are two jobs for each component.

        checkpoint_every ends the lineage after each so many stages: the components are written to the checkpoint folder (0: never).
        """
        began, before = time.monotonic(), self._live() if count else None
        retries = 0
        for number, stage in enumerate(self._stages(), 1):
            writes: dict[str, dict] = {}
            updates: dict[str, Any] = {}
            for system in (self.systems[i] for i in stage):
                retries += self._one(system, writes, updates)
            for component, columns in writes.items():
                self.workspace.apply(component, columns)
            for k, v in updates.items():
                self.workspace.insert_resource(k, v)
            if checkpoint_every and number % checkpoint_every == 0:
                self.workspace.checkpoint()
        rows = None if before is None else self._live() - before
        self.last_stats = RunStats(len(self.systems), retries, time.monotonic() - began, rows)
        return self.last_stats

    def _one(self, system: System, writes: dict, updates: dict) -> int:
        """Calls a system; its columns and resources are gathered for the stage's end."""
        ws = self.workspace

        def call() -> tuple[dict, dict]:
            try:
                if system.run is not None:
                    kept = ws.state()
                    try:
                        system.run(ws)
                    except BaseException:
                        ws.restore(kept)  # what a failed try has changed is taken back
                        raise
                    columns = {}
                else:
                    columns = system.columns(ws)
                return columns, system.resources(ws) if system.resources else {}
            except EngineError:
                raise
            except Exception as e:
                raise SystemExecutionError(f"{system.name}: {e}") from e

        (columns, resources), retries = system.retry.call(call)
        declared = system.access.expanded({n: c.schema.names for n, c in ws.components.items()}).writes
        for component, own in columns.items():
            undeclared = [f for f in own if (component, f) not in declared]
            if undeclared:
                raise ConfigurationError(f"{system.name} writes {component}.{', '.join(undeclared)} without saying so")
            writes.setdefault(component, {}).update(own)
        updates.update(resources)
        return retries

    def _live(self) -> int:
        return sum(self.workspace.live_rows(c) for c in self.workspace.components)

    def run_with_io(self, count: bool = False) -> RunStats:
        """Read all sources, run, write all sinks."""
        self.validate()
        for component, read in self.sources:
            self.workspace.append(component, read(self.workspace))
        stats = self.run(count)
        for component, write in self.sinks:
            write(self.workspace[component])
        return stats

    def run_items(self, items: Iterable[DataFrame]) -> list[DataFrame]:
        """Each item by itself, as one run over a workspace that holds it alone: the rows of the last sink's component (or of the source's)."""
        if len(self.sources) != 1:
            raise ConfigurationError(f"{self.name}: items need exactly one source")
        component, out = self.sources[0][0], []
        resources = dict(self.workspace._resources)
        for df in items:
            self.workspace.clear()
            self.workspace._resources.update(resources)
            self.workspace.append(component, df)
            self.run()
            for c, write in self.sinks:
                write(self.workspace[c])
            out.append(self.workspace[self.sinks[-1][0] if self.sinks else component])
        return out
