"""Enrichment from small tables with a default for what they lack."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.errors import ConfigurationError

#: Largest mapping that is put into the expression itself; larger ones are tables to join().
LITERAL_ENTRIES = 256


def mapped(key: Column, values: Mapping[Any, Any], default: Any) -> Column:
    """The value of a key, or the default: an expression without a join."""
    if len(values) > LITERAL_ENTRIES:
        raise ConfigurationError(f"a mapping of {len(values)} entries; over {LITERAL_ENTRIES} use a table")
    if not values:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def enriched(df: DataFrame, key: str, table: DataFrame, value: str, default: Any, alias: str | None = None) -> DataFrame:
    """The rows with the value that a table has for their key (its field of the same name), or the default.

    A left join: adaptive execution broadcasts the table if it is small enough and sorts and merges otherwise.
    """
    small = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    name = alias or value
    return df.join(small, F.col(key) == F.col("_key"), "left").withColumn(name, F.coalesce("_value", F.lit(default))).drop("_key", "_value")
