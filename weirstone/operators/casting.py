"""Rows brought to a target schema by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import SchemaError


def target_schema(schema: T.StructType, changes: Mapping[str, T.DataType]) -> T.StructType:
    """The schema with other types for some fields."""
    missing = [k for k in changes if k not in schema.names]
    if missing:
        raise SchemaError(f"no field {', '.join(missing)}")
    return T.StructType([T.StructField(f.name, changes.get(f.name, f.dataType), f.nullable) for f in schema])


def cast_rows(df: DataFrame, schema: T.StructType, safe: bool = True) -> DataFrame:
    """The target's fields in its order; others are left out. Safe: what can't be cast is null; otherwise it fails the query."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"the rows have no field {', '.join(missing)}")

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if df.schema[f.name].dataType == f.dataType:
            return c
        return (c.try_cast(f.dataType) if safe else c.cast(f.dataType)).alias(f.name)

    return df.select(*map(one, schema))
