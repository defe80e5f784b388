"""Event time in whole milliseconds, and the ids of the windows that a time falls into."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstone.errors import SchemaError


def millis(df: DataFrame, field: str) -> Column:
    """A time field as milliseconds since the epoch: longs are taken as they are, finer timestamps are cut towards zero."""
    kind = df.schema[field].dataType
    if isinstance(kind, T.LongType):
        return F.col(field)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.call_function("div", F.unix_micros(F.col(field).cast("timestamp")), F.lit(1000))
    raise SchemaError(f"{field}: {kind.simpleString()} is no event time; a long or a timestamp is")


def tumbling_id(ms: Column, size: int, offset: int = 0) -> Column:
    """Number of the tumbling window that a time is in, rounded down also before the epoch."""
    x = ms - F.lit(offset)
    return F.call_function("div", x - F.pmod(x, F.lit(size)), F.lit(size))


def sliding_ids(ms: Column, size: int, slide: int, offset: int = 0) -> Column:
    """Numbers of the sliding windows of a time, an array: ceil(size / slide) of them, the j-th as if the time were j slides earlier."""
    k = math.ceil(size / slide)
    return F.array(*(tumbling_id(ms - F.lit(j * slide), slide, offset) for j in range(k)))
