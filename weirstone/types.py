"""Declared schemas: type names, versions with migrations, and the fingerprint of a set of components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import ConfigurationError, SchemaError

#: Type names of configuration files. Unsigned types get the next wider signed one.
TYPE_NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float": T.FloatType(),
    "float64": T.DoubleType(),
    "double": T.DoubleType(),
    "utf8": T.StringType(),
    "string": T.StringType(),
    "varchar": T.StringType(),
    "largeutf8": T.StringType(),
    "large_utf8": T.StringType(),
    "binary": T.BinaryType(),
    "date32": T.DateType(),
    "date64": T.TimestampType(),
}


def parse_type(name: str) -> T.DataType:
    """The Spark type of a type name, whatever its case."""
    try:
        return TYPE_NAMES[name.lower()]
    except KeyError:
        raise ConfigurationError(f"unknown type name {name!r}; known are {', '.join(sorted(TYPE_NAMES))}") from None


def parse_schema(fields: Iterable[Mapping[str, object]]) -> T.StructType:
    """A schema from tables with name, type and optionally nullable (true unless given)."""
    out = []
    for f in fields:
        if "name" not in f or "type" not in f:
            raise ConfigurationError(f"a field needs name and type: {dict(f)}")
        out.append(T.StructField(str(f["name"]), parse_type(str(f["type"])), bool(f.get("nullable", True))))
    return T.StructType(out)


Migration = Callable[[DataFrame, int], DataFrame]


def no_migration(df: DataFrame, version: int) -> DataFrame:
    """The default: rows of another version are refused."""
    raise SchemaError(f"no migration from version {version}")


@dataclass(frozen=True)
class Component:
    """A named record type of one version; migrate turns rows of an older version into this one's."""

    name: str
    schema: T.StructType
    version: int = 1
    migrate: Migration = field(default=no_migration, compare=False)

    def current(self, df: DataFrame, version: int) -> DataFrame:
        """Rows of the given version as rows of this one."""
        if version == self.version:
            return df
        if version > self.version:
            raise SchemaError(f"{self.name}: version {version} is newer than {self.version}")
        return self.check(self.migrate(df, version))

    def check(self, df: DataFrame) -> DataFrame:
        """The rows, if they have exactly the declared fields in any order."""
        want = {f.name: f.dataType for f in self.schema}
        got = {f.name: f.dataType for f in df.schema}
        if want != got:
            off = sorted(k for k in want.keys() | got.keys() if want.get(k) != got.get(k))
            raise SchemaError(f"{self.name}: fields {', '.join(off)} differ from the declared schema")
        return df.select(*self.schema.names)

    def columns(self) -> list[Column]:
        return [F.col(n) for n in self.schema.names]


def fingerprint(components: Iterable[Component]) -> str:
    """Eight hex digits over names, versions and field names, in the order of the component names: FNV-1a of 32 bits."""
    h = 0x811C9DC5

    def feed(data: bytes) -> None:
        nonlocal h
        for b in data:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF

    for c in sorted(components, key=lambda c: c.name):
        feed(c.name.encode())
        feed(c.version.to_bytes(4, "little"))
        for f in c.schema.names:
            feed(f.encode())
    return f"{h:08x}"
