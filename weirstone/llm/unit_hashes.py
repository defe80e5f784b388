"""Substring dedup by hashing lines or paragraphs, and removing the passages that repeated ones make.

Units are lines (cut at a line feed, and inside long lines after sentence ends, as prose keeps whole paragraphs in one line) or, by
parameter, plain lines or paragraphs (cut at two or more line feeds). A unit is normalised (lower case, each run of white space one space,
trimmed) and hashed; of all occurrences of a digest the earliest (least id, then place) stays and the others are repeats. A run of
repeats that lie side by side in a text is a passage; passages of PASSAGE_WORDS words or more are removed, shorter ones, such as
a common sentence of its own, stay. Units of fewer than UNIT_WORDS words are not hashed: they neither end a
run nor count for it, and go if they lie inside a passage. A text without spaces has a word for each CHARS characters. Removed pieces are
kept as spans [start, end) in characters of the original text, with what ends their units.

Defined cases: a null text counts as empty; an empty text has no units; null ids rank last; of repeated rows the first read is the earliest; an empty
table gives an empty result; other columns stay as they are in deduplicated().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm import repeats
from weirstone.llm.shared import doc_schema

UNIT_WORDS, PASSAGE_WORDS, CHARS = 4, 25, 8
#: What ends a unit, and what counts as white space in one.
ENDS = {"sentence": re.compile(r"\n|[.!?][ \t]+|[。！？]"), "line": re.compile(r"\n"), "paragraph": re.compile(r"\n{2,}")}
SPACES = re.compile(r"[ \t\n\r\f]+")
WHITE = " \t\n\r\f"
#: White space inside a text that normalising changes.
UNEVEN = re.compile(r"[\t\r\f]| {2}")


def units_of(text: str, unit: str = "sentence") -> list[tuple[int, int]]:
    """Start and end of each unit in order, with what ends it; together they are the text."""
    ends = [m.end() for m in ENDS[unit].finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends, strict=False))


def hashed(text: str, unit: str = "sentence", unit_words: int = UNIT_WORDS) -> Iterator[tuple[int, str, int]]:
    """Number, normalised text and words of each unit that is hashed."""
    low = text.lower()  # has the same units, if not the same offsets
    uneven = UNEVEN.search(low) is not None or unit == "paragraph"
    for k, (b, e) in enumerate(units_of(low, unit)):
        own = low[b:e].strip(WHITE)
        if uneven:
            own = SPACES.sub(" ", own)
        words = max(own.count(" ") + 1, len(own) // CHARS)
        if own and words >= unit_words:
            yield k, own, words


def _marked(docs: DataFrame, unit: str, unit_words: int, id_col: str, text_col: str) -> DataFrame:
    rows = repeats.numbered(docs, id_col)
    found = repeats.occurrences(rows, text_col, lambda text: [(k, own) for k, own, _ in hashed(text, unit, unit_words)])
    return repeats.with_lists(rows, repeats.later(found), "unit")


def _kept(text: str, marks: list[int] | None, unit: str, unit_words: int, passage_words: int) -> tuple[str, list[tuple[int, int]], int]:
    """What stays of a text, the removed spans, and the number of units in them."""
    if not marks:
        return text, [], 0
    again, passages = set(marks), []
    first = last = words = 0
    for k, _, n in (*hashed(text, unit, unit_words), (-1, "", 0)):
        if k in again:
            first, last, words = (first if words else k), k, words + n
            continue
        if words >= passage_words:
            passages.append((first, last))
        words = 0
    units = units_of(text, unit)
    spans = [(units[a][0], units[b][1]) for a, b in passages]
    pieces, at = [], 0
    for b, e in spans:
        pieces.append(text[at:b])
        at = e
    return "".join([*pieces, text[at:]]), spans, sum(b - a + 1 for a, b in passages)


def deduplicated(docs: DataFrame, unit: str = "sentence", unit_words: int = UNIT_WORDS, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, the text without repeated passages, and removed: array of (start, end) in the original text."""
    marked = _marked(docs, unit, unit_words, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(None, [], 0) if m is None else _kept(t, m, unit, unit_words, passage_words) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            spans = pa.array([[{"start": b, "end": e} for b, e in s] for _, s, _ in kept], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _, _ in kept], pa.string()), spans], ["_doc", "_new", "_removed"])

    text = F.when(F.col("_marks").isNotNull(), repeats.text_in(text_col)).alias(repeats.TEXT)  # of changed rows alone
    out = marked.select("_doc", text, "_marks").mapInArrow(run, doc_schema(marked, "_new string, _removed array<struct<start:bigint,end:bigint>>"))
    return out.select(*((F.coalesce("_new", F.col("_doc").getField(c)) if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns if c != "removed"), F.col("_removed").alias("removed"))


def digests(docs: DataFrame, unit: str = "sentence", unit_words: int = UNIT_WORDS, passage_words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, removed_chars, removed_spans ("start-end" joined by commas) and kept_sha256 of every document."""
    marked = _marked(docs.select(id_col, text_col), unit, unit_words, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept = [_kept(t, m, unit, unit_words, passage_words) for t, m in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(units_of(t, unit)) for t in texts], pa.int64()),
                    pa.array([n for _, _, n in kept], pa.int64()),
                    pa.array([sum(e - b for b, e in s) for _, s, _ in kept], pa.int64()),
                    pa.array([",".join(f"{b}-{e}" for b, e in s) for _, s, _ in kept]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in kept]),
                ],
                ["doc_id", "n_units", "n_removed", "removed_chars", "removed_spans", "kept_sha256"],
            )

    return marked.select("_id", repeats.text_in(text_col), "_marks").mapInArrow(run, "doc_id bigint, n_units bigint, n_removed bigint, removed_chars bigint, removed_spans string, kept_sha256 string")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?][ \t]+|[。！？])', '\1' || chr(1), 'g'), chr(1)) AS pieces FROM documents
), units AS (
  SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM cut
), sized AS (
  SELECT doc_id, k, piece, regexp_replace(trim(lower(piece), ' ' || chr(9) || chr(10) || chr(13) || chr(12)), '[ \t\n\r\f]+', ' ', 'g') AS s,
         CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e
  FROM units WHERE piece <> ''
), counted AS (
  SELECT *, e - length(piece) AS b, greatest(length(s) - length(replace(s, ' ', '')) + 1, length(s) // 8) AS words FROM sized
), judged AS (
  SELECT doc_id, k, b, e, words, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 AS again FROM counted WHERE s <> '' AND words >= 4
), runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, again ORDER BY k) AS run FROM judged
), passages AS (
  SELECT doc_id, min(k) AS first, max(k) AS last, min(b) AS b, max(e) AS e FROM runs WHERE again GROUP BY doc_id, run HAVING sum(words) >= 25
), spans AS (
  SELECT doc_id, sum(last - first + 1) AS n_removed, sum(e - b) AS removed_chars, string_agg(CAST(b AS VARCHAR) || '-' || CAST(e AS VARCHAR), ',' ORDER BY b) AS removed_spans FROM passages GROUP BY doc_id
), kept AS (
  SELECT u.doc_id, count(*) AS n_units, coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE first IS NULL), '') AS kept
  FROM sized u LEFT JOIN passages p ON p.doc_id = u.doc_id AND u.k BETWEEN p.first AND p.last GROUP BY u.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(removed_spans, '') AS removed_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""
