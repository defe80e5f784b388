"""A workspace: named components (DataFrames of a declared schema) and resources (any Python object).

Rows carry their liveness in a column instead of a position: mark_dead() flags rows by a predicate, and compact() filters them. Dead rows are
seen by scans and sinks until then. Everything is lazy; only rows() and live_rows() count.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.errors import ComponentNotFoundError, ConfigurationError, ResourceNotFoundError, SchemaError
from weirstone.types import Component, Migration, fingerprint, no_migration

ALIVE = "__alive"


class Workspace:
    def __init__(self, spark: SparkSession, components: Mapping[str, DataFrame] | None = None, resources: Mapping[str, Any] | None = None):
        self.spark = spark
        self.components: dict[str, Component] = {}
        self.frames: dict[str, DataFrame] = {}
        self._resources: dict[str, Any] = dict(resources or {})
        for name, df in (components or {}).items():
            self.register(name, df.drop(ALIVE).schema)
            self.append(name, df.drop(ALIVE))

    # -- declaration

    def register(self, name: str, schema: Any, version: int = 1, migrate: Migration = no_migration) -> None:
        """Declare a component. Declaring it again changes nothing."""
        if name not in self.components:
            self.components[name] = Component(name, schema, version, migrate)
            self.frames[name] = self.spark.createDataFrame([], schema).withColumn(ALIVE, F.lit(True))

    def schemas(self) -> dict[str, Component]:
        return dict(self.components)

    def fingerprint(self) -> str:
        return fingerprint(self.components.values())

    def _known(self, name: str) -> Component:
        try:
            return self.components[name]
        except KeyError:
            raise ComponentNotFoundError(f"no component {name!r}; there are {', '.join(sorted(self.components)) or 'none'}") from None

    def state(self) -> tuple[dict, dict, dict]:
        """What is declared and held now, for restore()."""
        return dict(self.components), dict(self.frames), dict(self._resources)

    def restore(self, state: tuple[dict, dict, dict]) -> None:
        """Back to what state() gave, also what has been declared since."""
        self.components, self.frames, self._resources = (dict(x) for x in state)

    # -- reading

    def __getitem__(self, name: str) -> DataFrame:
        """All rows, dead ones too, without the liveness column."""
        self._known(name)
        return self.frames[name].drop(ALIVE)

    def columns(self, name: str, *fields: str) -> DataFrame:
        missing = [f for f in fields if f not in self._known(name).schema.names]
        if missing:
            raise SchemaError(f"{name} has no field {', '.join(missing)}")
        return self.frames[name].select(*fields)

    def rows(self, name: str) -> int:
        self._known(name)
        return self.frames[name].count()

    def live_rows(self, name: str) -> int:
        self._known(name)
        return self.frames[name].where(ALIVE).count()

    # -- writing

    def append(self, name: str, df: DataFrame) -> None:
        """Rows of exactly the declared fields, live."""
        self.frames[name] = self.frames[name].unionByName(self._known(name).check(df).withColumn(ALIVE, F.lit(True)))

    def replace(self, name: str, df: DataFrame) -> None:
        """Other rows of the same schema in place of all that are there."""
        self.frames[name] = self._known(name).check(df).withColumn(ALIVE, F.lit(True))

    def apply(self, name: str, writes: Mapping[str, Column]) -> None:
        """New values for fields, all computed from the rows as they are now."""
        schema = self._known(name).schema
        missing = [f for f in writes if f not in schema.names]
        if missing:
            raise SchemaError(f"{name} has no field {', '.join(missing)}")
        self.frames[name] = self.frames[name].withColumns({f: c.cast(schema[f].dataType) for f, c in writes.items()})

    # -- liveness

    def mark_dead(self, name: str, predicate: Column) -> None:
        self._known(name)
        self.frames[name] = self.frames[name].withColumn(ALIVE, F.col(ALIVE) & ~F.coalesce(predicate, F.lit(False)))

    def should_compact(self, name: str) -> bool:
        """Whether more than a quarter of the rows are dead."""
        n, live = self.frames[name].agg(F.count("*"), F.count(F.when(F.col(ALIVE), 1))).first()
        return n - live > n // 4

    def compact(self) -> None:
        self.frames = {k: df.where(ALIVE) for k, df in self.frames.items()}

    def clear(self) -> None:
        """No rows and no resources; the declarations stay."""
        for name, c in self.components.items():
            self.frames[name] = self.spark.createDataFrame([], c.schema).withColumn(ALIVE, F.lit(True))
        self._resources.clear()

    def clone_empty(self) -> Workspace:
        other = Workspace(self.spark)
        for c in self.components.values():
            other.register(c.name, c.schema, c.version, c.migrate)
        return other

    def checkpoint(self) -> None:
        """Write all components to the checkpoint folder; what comes after starts from there. In local mode a temporary folder stands in for one that isn't set."""
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            folder = self.spark.conf.get("spark.checkpoint.dir", None)
            if not folder and not context.master.startswith("local"):
                raise ConfigurationError("spark.checkpoint.dir isn't set: executors and driver need a folder that they share")
            context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weirstone-"))
        self.frames = {k: df.checkpoint() for k, df in self.frames.items()}

    # -- resources

    def insert_resource(self, name: str, value: Any) -> None:
        self._resources[name] = value

    def resource(self, name: str) -> Any:
        try:
            return self._resources[name]
        except KeyError:
            raise ResourceNotFoundError(f"no resource {name!r}") from None

    def has_resource(self, name: str) -> bool:
        return name in self._resources
