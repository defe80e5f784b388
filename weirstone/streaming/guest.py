"""Programs from outside as tables to tables: what they need, what they make, and what they keep from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weirstone.types import Component, fingerprint


class Guest(Protocol):
    """The contract of a batch program."""

    def describe(self) -> list[Component]:
        """The components it reads and writes."""

    def run_batch(self, rows: DataFrame, prior: DataFrame | None, config: Mapping[str, str]) -> tuple[DataFrame, DataFrame | None]:
        """Rows out, and the state for the next batch."""


@dataclass
class ArrowGuest:
    """A stateless program on Arrow batches; it runs in the executors' Python workers, as many at once as there are partitions."""

    function: Callable[[pa.RecordBatch, Mapping[str, str]], pa.RecordBatch]
    component: Component
    out: T.StructType
    config: dict[str, str] = field(default_factory=dict)

    def describe(self) -> list[Component]:
        return [self.component]

    def run_batch(self, rows: DataFrame, prior: DataFrame | None = None, config: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame | None]:
        own, call = {**self.config, **(config or {})}, self.function

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield call(batch, own)

        return self.component.check(rows).mapInArrow(run, self.out), prior


@dataclass
class Chain:
    """Programs one after the other on the same component; all must have the same fingerprint."""

    guests: list[Any]

    def __post_init__(self) -> None:
        from weirstone.errors import ConfigurationError

        prints = {fingerprint(g.describe()) for g in self.guests}
        if len(prints) > 1:
            raise ConfigurationError(f"the programs' schemas differ: {', '.join(sorted(prints))}")

    def run_batch(self, rows: DataFrame, prior: list[DataFrame | None] | None = None, config: Mapping[str, str] | None = None) -> tuple[DataFrame, list[DataFrame | None]]:
        states: list[DataFrame | None] = []
        for k, guest in enumerate(self.guests):
            rows, state = guest.run_batch(rows, prior[k] if prior else None, config or {})
            states.append(state)
        return rows, states
