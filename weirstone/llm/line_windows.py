"""Line dedup by overlapping windows of three lines.

Lines are cut at line feeds; blank lines neither count nor go. Each three consecutive lines of a text, trimmed, are a window.
A window that occurs anywhere twice or more keeps its earliest occurrence (least id, then place); the lines
that any later occurrence covers are merged and removed. An occurrence that overlaps the earliest one in the same text
removes only what lies beyond the earliest's lines, so of a line repeated on and on three stay.

Defined cases: a null text counts as empty; an empty text and texts of fewer than three lines lose nothing; null ids rank last; of repeated rows the
first read is the earliest; an empty table gives an empty result; other columns stay as they are in deduplicated().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm import repeats
from weirstone.llm.shared import doc_schema

WINDOW = 3
#: Fixed value: what is trimmed off a line.
SPACES = " \t\r\v\f"


def lines_of(text: str) -> list[tuple[int, str]]:
    """Place among all lines, and the trimmed text, of each line that isn't blank."""
    return [(k, s) for k, line in enumerate(text.split("\n")) if (s := line.strip(SPACES))]


def windows(text: str) -> Iterator[tuple[int, str]]:
    """Number and text of each window; the number is that of its first line among those that aren't blank."""
    lines = [s for _, s in lines_of(text)]
    for k in range(len(lines) - WINDOW + 1):
        yield k, "\n".join(lines[k : k + WINDOW])


def without(text: str, starts: list[int]) -> tuple[str, int]:
    """The text without the lines that the windows starting there cover, and their number. A start is packed as 4 * line + lines spared at its front."""
    if not starts:
        return text, 0
    lines, places = text.split("\n"), [k for k, _ in lines_of(text)]
    gone = {places[k] for s in starts for k in range(s // 4 + s % 4, s // 4 + WINDOW)}
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(gone)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = repeats.numbered(docs, id_col)
    found = repeats.later(repeats.occurrences(rows, text_col, windows))
    ahead = F.col("first_unit") + WINDOW - F.col("unit")  # lines of the earliest window that this one begins with
    spared = F.when((F.col("first_row") == F.col(repeats.ROW)) & (ahead > 0), F.least(ahead, F.lit(WINDOW))).otherwise(0)
    return repeats.with_lists(rows, found.select(repeats.ROW, (F.col("unit") * 4 + spared).alias("start")), "start")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, their texts without the removed lines. A text from which nothing goes stays as it is, null too."""
    marked = _marked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if s is None else without(t, s)[0] for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_doc", "_new"])

    text = F.when(F.col("_marks").isNotNull(), repeats.text_in(text_col)).alias(repeats.TEXT)  # of changed rows alone
    out = marked.select("_doc", text, "_marks").mapInArrow(run, doc_schema(marked, "_new string"))
    return out.select(*((F.coalesce("_new", F.col("_doc").getField(c)) if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (not blank), n_removed and kept_sha256 of every document."""
    marked = _marked(docs.select(id_col, text_col), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = [without(t, s or []) for t, s in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(lines_of(t)) for t in texts], pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _ in kept])],
                ["doc_id", "n_lines", "n_removed", "kept_sha256"],
            )

    return marked.select("_id", repeats.text_in(text_col), "_marks").mapInArrow(run, "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), lines AS (
  SELECT doc_id, line, place, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s,
         CASE WHEN trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' THEN row_number() OVER (PARTITION BY doc_id, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' ORDER BY place) END AS k
  FROM cut
), windows AS (
  SELECT doc_id, k, s || chr(10) || lead(s, 1) OVER w || chr(10) || lead(s, 2) OVER w AS three FROM lines WHERE k IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), ranked AS (
  SELECT doc_id, k, first_value(doc_id) OVER v AS first_doc, first_value(k) OVER v AS first_k FROM windows WHERE three IS NOT NULL WINDOW v AS (PARTITION BY three ORDER BY doc_id, k)
), gone AS (
  SELECT DISTINCT doc_id, k + j AS k FROM ranked, (VALUES (0), (1), (2)) AS t(j)
  WHERE (doc_id <> first_doc OR k <> first_k) AND NOT (doc_id = first_doc AND k + j < first_k + 3)
)
SELECT l.doc_id, count(l.k) AS n_lines, count(g.k) AS n_removed, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id
"""
