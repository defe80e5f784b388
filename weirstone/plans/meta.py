"""What a system declares to read and write: fields, whole components and resources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column

from weirstone.errors import ConfigurationError
from weirstone.plans.retry import Retry

if TYPE_CHECKING:
    from weirstone.operators.workspace import Workspace

ALL = "*"


@dataclass(frozen=True)
class Access:
    """Declared fields as (component, field), a field of * being all of them, and resource names."""

    name: str
    reads: frozenset[tuple[str, str]] = frozenset()
    writes: frozenset[tuple[str, str]] = frozenset()
    resource_reads: frozenset[str] = frozenset()
    resource_writes: frozenset[str] = frozenset()

    def read(self, component: str, *fields: str) -> Access:
        return self._with("reads", {(component, f) for f in fields or (ALL,)})

    def write(self, component: str, *fields: str) -> Access:
        return self._with("writes", {(component, f) for f in fields or (ALL,)})

    def read_resource(self, *names: str) -> Access:
        return self._with("resource_reads", set(names))

    def write_resource(self, *names: str) -> Access:
        return self._with("resource_writes", set(names))

    def _with(self, which: str, more: set) -> Access:
        values = {k: getattr(self, k) for k in ("name", "reads", "writes", "resource_reads", "resource_writes")}
        return Access(**(values | {which: values[which] | more}))

    def expanded(self, fields: dict[str, list[str]]) -> Access:
        """With every field by name; a field that no component has is an error."""

        def all_of(own: frozenset[tuple[str, str]]) -> frozenset[tuple[str, str]]:
            out = set()
            for c, f in own:
                if c not in fields:
                    raise ConfigurationError(f"{self.name}: no component {c!r}")
                if f != ALL and f not in fields[c]:
                    raise ConfigurationError(f"{self.name}: {c} has no field {f!r}")
                out |= {(c, x) for x in (fields[c] if f == ALL else [f])}
            return frozenset(out)

        return Access(self.name, all_of(self.reads), all_of(self.writes), self.resource_reads, self.resource_writes)


#: A system of columns: the workspace's resources to {(component): {field: Column}}. All columns are computed from the rows before the stage.
ColumnWrites = dict[str, dict[str, Column]]


@dataclass(frozen=True)
class System:
    """A step of a pipeline. Either columns is given, which says the new columns from the rows before its stage, or run, which changes the
    workspace in any way its declaration covers."""

    access: Access
    columns: Callable[[Workspace], ColumnWrites] | None = None
    run: Callable[[Workspace], None] | None = None
    resources: Callable[[Workspace], dict[str, Any]] | None = None
    retry: Retry = field(default_factory=Retry)

    def __post_init__(self) -> None:
        if (self.columns is None) == (self.run is None):
            raise ConfigurationError(f"{self.access.name}: give either columns or run")

    @property
    def name(self) -> str:
        return self.access.name
