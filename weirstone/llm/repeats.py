"""Repeated units over all rows: what the dedup operators on lines, paragraphs and windows of lines have in common.

Every unit of every row is an occurrence (row, rank, unit number, 128-bit digest). The earliest occurrence of each digest is found
with a partial minimum before the shuffle, so a digest that a third of all rows have costs a row for each task. The other
occurrences come from a sort-merge join against the digests that occur twice or more, one row for each digest, which adaptive
execution may split on the side of a hot digest. What is to be removed goes back to the rows as one list for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.llm.shared import spool, text_batches, whole_row

ROW, TEXT = "_row", "_text"


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """The rows in a shared table as _doc, each with a number of its own and its rank (null ids last)."""
    return spool(docs.select(whole_row(docs), F.monotonically_increasing_id().alias(ROW), F.col(id_col).cast("bigint").alias("_id")))


def text_in(text_col: str) -> Column:
    """The text of a numbered row (null: empty)."""
    return F.coalesce(F.col("_doc").getField(text_col).cast("string"), F.lit("")).alias(TEXT)


def occurrences(rows: DataFrame, text_col: str, units: Callable[[str], Iterable[tuple[int, str]]]) -> DataFrame:
    """_row, _id, unit, hi, lo: the digests of units(text), which gives unit numbers and normalised texts, in a shared table,
    so that texts are cut once for both its readers."""
    text_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, numbers, digests = [], [], []
            for place, text in enumerate(batch.column(2)):
                for number, own in units(text.as_py()):
                    places.append(place)
                    numbers.append(number)
                    digests.append(xxhash.xxh3_128_digest(own))
            halves = np.frombuffer(b"".join(digests), np.int64)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(halves[::2]), pa.array(halves[1::2])], [ROW, "_id", "unit", "hi", "lo"])

    return spool(rows.select(ROW, "_id", text_in(text_col)).mapInArrow(run, f"{ROW} bigint, _id bigint, unit int, hi bigint, lo bigint"))


def later(found: DataFrame) -> DataFrame:
    """All occurrences but the earliest of each digest: _row, unit, and the row and unit of the earliest as first_row, first_unit.

    Earliest is the least (id, row, unit), null ids last.
    """
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col(ROW), F.col("unit"))
    first = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", F.col(f"first.{ROW}").alias("first_row"), F.col("first.unit").alias("first_unit"))
    first = spool(first)  # so that the join's sides are plain shuffles, which adaptive execution splits where a digest is hot
    return found.join(first.hint("merge"), ["hi", "lo"]).where((F.col(ROW) != F.col("first_row")) | (F.col("unit") != F.col("first_unit"))).select(ROW, "unit", "first_row", "first_unit")


def with_lists(rows: DataFrame, marks: DataFrame, item: str) -> DataFrame:
    """The rows with the sorted list of the marks of each, or an empty one."""
    lists = marks.groupBy(ROW).agg(F.sort_array(F.collect_list(item)).alias("_marks"))
    return rows.join(lists, ROW, "left")
