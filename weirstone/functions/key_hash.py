"""64-bit FNV-1a over key columns, as an expression.

The hash is kept in two halves of 32 bits, as products of whole 64-bit numbers would overflow. Operators group by the keys
themselves and hash the few result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offset basis, the prime's low part (its other bit is a shift by 40), and the marks between keys.
OFFSET_HIGH, OFFSET_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
SEPARATOR, NULL, VALUE = b"\x00", b"\x01", b"\x02"
MASK = 0xFFFFFFFF


def key_bytes(keys: Sequence[Column]) -> Column:
    """The bytes that are hashed: for each key a mark, its text if it isn't null, and a separator between keys."""
    parts: list[Column] = []
    for n, k in enumerate(keys):
        if n:
            parts.append(F.lit(SEPARATOR))
        parts.append(F.when(k.isNull(), F.lit(NULL)).otherwise(F.concat(F.lit(VALUE), k.cast("string").cast("binary"))))
    return F.concat(*parts)


def key_hash(keys: Sequence[Column]) -> Column:
    """The signed 64-bit hash of the keys; 0 if there are none."""
    if not keys:
        return F.lit(0).cast("bigint")
    digits = F.hex(key_bytes(keys))
    octets = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))
    mask = F.lit(MASK).cast("bigint")

    def step(state: Column, octet: Column) -> Column:
        low = state["low"].bitwiseXOR(octet)
        product = low * PRIME_LOW
        high = (state["high"] * PRIME_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("high"), product.bitwiseAND(mask).alias("low"))

    start = F.struct(F.lit(OFFSET_HIGH).cast("bigint").alias("high"), F.lit(OFFSET_LOW).cast("bigint").alias("low"))
    return F.aggregate(octets, start, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))
