"""The five window aggregates. They differ from SQL on groups without values: sum is 0, min and max are the infinities, mean is
NaN, and count counts rows, null or not, as a double."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import ConfigurationError, SchemaError

#: Of each aggregate the value of a group without values.
EMPTY = {"sum": 0.0, "min": float("inf"), "max": float("-inf"), "mean": float("nan")}
KINDS = ("sum", "min", "max", "count", "mean")


@dataclass(frozen=True)
class Reduce:
    """One aggregate of one double field in each window and key."""

    field: str
    kind: str = "sum"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ConfigurationError(f"unknown aggregate {self.kind!r}; known are {', '.join(KINDS)}")

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.field}"

    def check(self, df: DataFrame) -> None:
        if self.field not in df.columns:
            raise SchemaError(f"no field {self.field!r} to aggregate")
        if not isinstance(df.schema[self.field].dataType, T.DoubleType):
            raise SchemaError(f"{self.field}: {df.schema[self.field].dataType.simpleString()} can't be aggregated; a double can")

    def column(self) -> Column:
        """The aggregate in one step."""
        return finish(self.kind, partials(F.col(self.field))).alias(self.name)


def partials(value: Column) -> dict[str, Column]:
    """Aggregates of rows from which all five kinds can be finished, also after further merging."""
    return {"rows": F.count(F.lit(1)), "values": F.count(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value)}


def merged() -> dict[str, Column]:
    """Aggregates of partial rows with these columns."""
    return {"rows": F.sum("rows"), "values": F.sum("values"), "sum": F.sum("sum"), "min": F.min("min"), "max": F.max("max")}


def finish(kind: str, parts: dict[str, Column]) -> Column:
    """The kind's value from its partials."""
    if kind == "count":
        return parts["rows"].cast("double")
    if kind == "mean":
        return F.coalesce(F.try_divide(parts["sum"], parts["values"].cast("double")), F.lit(EMPTY["mean"]))
    return F.coalesce(parts[kind], F.lit(EMPTY[kind]))
