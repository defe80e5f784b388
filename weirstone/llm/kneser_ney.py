"""Quality rules: counted base rules, then perplexity bands under a modified Kneser-Ney model of byte n-grams.

The model is counted by Spark over every document that passes the base rules: each task counts the n-grams of the highest order as
exact integers (the language and up to ORDER bytes fit 64 bits), and the sums meet by n-gram. The lower
orders hold continuation counts, the number of different bytes seen before. Each order of each language has three discounts for its
counts of one, two and more. For scoring, every order is a pair of sorted arrays: n-gram and log probability (with interpolation already
worked in), and context and its back-off weight. n-grams are kept whole, packed with their language into 64 bits, so none shares another's
counts and the model grows with the corpus: 12 bytes for each distinct n-gram and context of each order, which for the bytes of written languages grow ever more slowly.
Languages are broadcast in BUNDLES parts, and a task loads those of its own texts.

A document's perplexity is 2 ** (mean bits a byte). A language's band is centred on the median of log2(perplexity) of its
distinct texts that pass the base rules. The mean over n bytes spreads as 1 / sqrt(n), so the deviations are measured times sqrt(n), and the
band of a document ends LOW_WIDTH below and HIGH_WIDTH above the centre in robust deviations (1.4826 times the median absolute
deviation) divided by sqrt(n): a long text that is a little odd throughout leaves it, a short one doesn't. Fewer than
LEAST_TEXTS distinct texts, or ones without spread, tell no deviation; there the ends are LEAST_BAND bits away.

Defined cases: a null text counts as empty, has no words and fails the base rules; a null language is a language of its own; rows with
equal ids are judged one by one; an empty table gives an empty result; other columns stay as they are in filtered().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.llm.shared import byte_views, doc_schema, run_bounds, small_enough, spool, text_batches, text_of, unpacked, whole_row

ORDER = 5
#: Bits of a packed n-gram: its language's number and ORDER bytes. Keys are the n-grams themselves.
HASH_BITS = 16 + 8 * ORDER
LOW_WIDTH, HIGH_WIDTH = 5.0, 3.0
LEAST_TEXTS, LEAST_BAND = 20, 1.0
#: Words, symbols, the words of a window, and the limits of the base rules.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: n-grams that a task holds before it merges them into its sums.
BLOCK_BYTES = 4 << 20
BUNDLES = 64
START = 32  # what stands before a text: one space


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    n, repeated = len(words), 0
    if n >= WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) < len(windows):
            times: dict[tuple, int] = {}
            for w in windows:
                times[w] = times.get(w, 0) + 1
            covered = np.zeros(n + 1, np.int64)
            twice = np.flatnonzero([times[w] > 1 for w in windows])
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + WINDOW, -1)
            repeated = int((np.cumsum(covered) > 0).sum())
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


# -- n-grams of bytes -----------------------------------------------------------------------------------------


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the n-gram that ends in it, packed into an integer; START stands before each text."""
    n = len(data)
    out = np.zeros(n, np.uint64)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    wide = data.astype(np.uint64)
    for back in range(order - 1, -1, -1):
        column = np.full(n, START, np.uint64)
        column[back:] = wide[: n - back] if back else wide
        column[place < back] = START
        out = out << np.uint64(8) | column
    return out


def tagged(packed: np.ndarray, lang: np.ndarray, order: int) -> np.ndarray:
    """n-grams with their languages' 16-bit numbers above their bytes."""
    return packed | lang << np.uint64(8 * order)


def suffixes(keys: np.ndarray, order: int) -> np.ndarray:
    """The n-grams without their first byte."""
    low = np.uint64((1 << (8 * (order - 1))) - 1)
    return tagged(keys & low, keys >> np.uint64(8 * order), order - 1)


def lang_number(lang: str | None) -> int:
    """A 16-bit number for a language name."""
    h = 0x811C9DC5
    for b in (lang if lang is not None else "\0").encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h >> 16 ^ h & 0xFFFF


@dataclass
class Sums:
    """Counts of n-grams, merged block by block."""

    keys: np.ndarray
    counts: np.ndarray

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate((self.keys, keys))
        self.keys, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, counts)), len(self.keys)).astype(np.int64)


def count(rows: DataFrame) -> DataFrame:
    """key, n: how often each n-gram of the highest order occurs in the rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held: list[np.ndarray] = []
        size = 0

        def merge() -> None:
            nonlocal held, size
            if held:
                sums.add(*np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0

        for batch in batches:
            keep = [not base_failed(c[0], c[4]) for c in map(base_counts, batch.column(1).to_pylist())]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            data, offsets = byte_views(batch.column(1))
            own = grams(data, offsets, ORDER)
            langs = np.array([lang_number(x) for x in batch.column(0).to_pylist()], np.uint64)
            held.append(own | np.repeat(langs, np.diff(offsets)) << np.uint64(8 * ORDER))
            size += len(own)
            if size > BLOCK_BYTES:
                merge()
        merge()
        for at in range(0, len(sums.keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys[at : at + 100_000].view(np.int64)), pa.array(sums.counts[at : at + 100_000])], ["key", "n"])

    return rows.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def packed_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each column of a task as bytes: as rows they would take many times the driver's memory."""
    held = list(batches)
    if held:
        names = held[0].schema.names
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(b.column(k).to_numpy().tobytes() for b in held)], pa.binary()) for k in range(len(names))], names)


def exact_counts(exact: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 to ORDER: its sorted distinct n-grams (packed with their language) and their counts.

    Spark makes continuation counts from the exact n-grams, order by order; 16 bytes for each n-gram come to the driver.
    """
    spark = exact.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    out = []
    level = exact
    for order in range(ORDER, 0, -1):
        parts = level.select("key", "n").mapInArrow(packed_columns, "key binary, n binary").collect()
        keys, counts = (np.frombuffer(b"".join(r[c] for r in parts), kind) for c, kind in (("key", np.uint64), ("n", np.int64)))
        del parts
        low = np.uint64((1 << (8 * order)) - 1)  # Spark's keys have the language above ORDER bytes, here it is above the order's own
        keys = tagged(keys & low, keys >> np.uint64(8 * ORDER), order)
        order_of = np.argsort(keys, kind="stable")
        out.append((keys[order_of], counts[order_of]))
        if order > 1:  # the language stays in the bits above ORDER bytes
            low = (1 << (8 * (order - 1))) - 1
            high = ~((1 << (8 * ORDER)) - 1)
            level = level.select((F.col("key").bitwiseAND(F.lit(low).cast("bigint")).bitwiseOR(F.col("key").bitwiseAND(F.lit(high).cast("bigint")))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return out[::-1]


@dataclass
class Model:
    """Sorted arrays: for each order its n-grams with log2 probabilities, and its contexts with log2 back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
        known, values = table
        if not len(known):
            return np.full(len(keys), missing, np.float32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[at] == keys
        return np.where(found, values[at], np.float32(missing)), found

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last byte of each distinct packed n-gram of the highest order."""
        lang, own = keys >> np.uint64(8 * ORDER), keys & np.uint64((1 << (8 * ORDER)) - 1)
        out = np.full(len(keys), -8.0, np.float32)  # no order knows it: one of 256 bytes
        todo, weight = np.arange(len(keys)), np.zeros(len(keys), np.float32)
        for order in range(ORDER, 0, -1):
            tail = own[todo] & np.uint64((1 << (8 * order)) - 1)
            tag = lang[todo]
            p, found = self._look(self.grams[order - 1], tagged(tail, tag, order), -8.0)
            out[todo[found]] = p[found] + weight[todo[found]]
            todo, tail, tag = todo[~found], tail[~found], tag[~found]
            back, _ = self._look(self.contexts[order - 1], tagged(tail >> np.uint64(8), tag, order - 1), 0.0)
            weight[todo] += back
        out[todo] = -8.0 + weight[todo]
        return -out

    def score(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """log2 of the perplexity of each text; NaN where it is empty."""
        keys = grams(data, offsets, ORDER) | np.repeat(langs.astype(np.uint64), np.diff(offsets)) << np.uint64(8 * ORDER)
        own, at = np.unique(keys, return_inverse=True)
        sums = np.concatenate(([0.0], np.cumsum(self.bits(own).astype(np.float64)[at])))
        n = np.diff(offsets)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, (sums[offsets[1:]] - sums[offsets[:-1]]) / n, np.nan)


class Models:
    """The model of each language, in bundles that are broadcast one by one."""

    def __init__(self, by_lang: dict[int, Model]):
        self.by_lang = by_lang
        self.shared: dict[int, Broadcast] | None = None

    def share(self, spark: SparkSession) -> Models:
        """The same with its languages in broadcast variables, of which a task opens those it meets."""
        out = Models({})
        bundles: dict[int, dict[int, Model]] = {}
        for lang, model in self.by_lang.items():
            bundles.setdefault(lang % BUNDLES, {})[lang] = model
        out.shared = {k: spark.sparkContext.broadcast(own) for k, own in bundles.items()}
        return out

    def of(self, lang: int) -> Model:
        """A language's model; of an unknown one it knows nothing."""
        known = self.by_lang if self.shared is None else self.shared[lang % BUNDLES].value if lang % BUNDLES in self.shared else {}
        return known[lang] if lang in known else Model([_NONE] * ORDER, [_NONE] * ORDER)

    def score(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """log2 of the perplexity of each text under its language's model; NaN where it is empty."""
        out = np.full(len(langs), np.nan)
        for lang in np.unique(langs).tolist():
            rows = np.flatnonzero(langs == lang)
            sizes = offsets[rows + 1] - offsets[rows]
            own = np.concatenate(([0], np.cumsum(sizes)))
            at = np.arange(own[-1]) + np.repeat(offsets[rows] - own[:-1], sizes)
            out[rows] = self.of(lang).score(data[at], own, langs[rows])
        return out


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.float32))


def by_language(tables: list[tuple[np.ndarray, np.ndarray]]) -> Models:
    """The models of all languages from the counts of each order, which are sorted by language."""
    own = [keys >> np.uint64(8 * order) for order, (keys, _) in enumerate(tables, 1)]
    found = np.unique(own[0])
    cuts = [(np.searchsorted(x, found, "left"), np.searchsorted(x, found, "right")) for x in own]
    return Models({int(lang): build([(keys[b[k] : e[k]], counts[b[k] : e[k]]) for (keys, counts), (b, e) in zip(tables, cuts, strict=True)]) for k, lang in enumerate(found.tolist())})


def build(tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Modified Kneser-Ney from the exact counts of each order of one language."""
    grams_, contexts = [], []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for order, (keys, counts) in enumerate(tables, 1):
        n = [float((counts == k).sum()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
        discount = np.array([0.0] + [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3)])
        d = discount[np.minimum(counts, 3)]
        context = keys >> np.uint64(8)  # sorted like the n-grams, as it is their beginning
        bounds = run_bounds(context)
        own, at = context[bounds[:-1]], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        total = np.bincount(at, counts, len(own))
        gamma = np.maximum(np.bincount(at, d, len(own)), 1e-9 * total) / total if len(own) else total
        if below is None:
            lower = np.full(len(keys), 1 / 256)
        else:
            lower = below[1][np.searchsorted(below[0], suffixes(keys, order))]  # each is there: lower orders are made of these
        p = (counts - d) / total[at] + gamma[at] * lower if len(keys) else np.zeros(0)
        below = (keys, p)
        grams_.append((keys, np.log2(p).astype(np.float32)))
        contexts.append((own, np.log2(gamma).astype(np.float32)))
    return Model(grams_, contexts)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Models:
    """Count over all documents and build the models."""
    text_batches(docs.sparkSession)
    exact = spool(count(docs.select(F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))))
    return by_language(exact_counts(exact))


def measured(docs: DataFrame, model: Models, keep: bool, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Base counts and log2 perplexity of every row; with keep, beside the row's own columns as a struct _doc."""
    spark = docs.sparkSession
    text_batches(spark)
    own = model.share(spark)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([base_counts(t) for t in batch.column("_text").to_pylist()], np.int64).reshape(-1, 5)
            data, offsets = byte_views(batch.column("_text"))
            langs = batch.column("_lang").to_pylist()
            bits = own.score(data, offsets, np.array([lang_number(x) for x in langs], np.uint64))
            failed = [base_failed(int(c[0]), int(c[4])) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("_lang"), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(5)), pa.array(failed), pa.array(bits), pa.array(np.diff(offsets))],
                [batch.schema.names[0], "_lang", *names, "base_failed", "bits", "_bytes"],
            )

    first = whole_row(docs) if keep else F.col(id_col).alias("_doc")
    rows = docs.select(first, F.col(lang_col).cast("string").alias("_lang"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(run, doc_schema(rows, f"_lang string, {', '.join(f'{x} bigint' for x in names)}, base_failed boolean, bits double, _bytes bigint"))


def bands(rows: DataFrame) -> DataFrame:
    """_of (the language), middle and unit of each language: the centre of log2 perplexity, and the robust deviation of one byte
    (null where it isn't known)."""
    good = rows.where(~F.col("base_failed") & ~F.isnan("bits")).groupBy("_lang", "_bytes", F.round("bits", 6).alias("about")).agg(F.min("bits").alias("bits"))  # copies count once
    middle = good.groupBy(F.col("_lang").alias("_of")).agg(F.percentile_approx("bits", 0.5, 10_000).alias("middle"))
    off = good.join(middle, F.col("_lang").eqNullSafe(F.col("_of"))).select("_of", "middle", (F.abs(F.col("bits") - F.col("middle")) * F.sqrt("_bytes")).alias("off"))
    unit = 1.4826 * F.percentile_approx("off", 0.5, 10_000)
    return off.groupBy("_of", "middle").agg(F.when((F.count("*") >= LEAST_TEXTS) & (unit > 0), unit).alias("unit"))


def judged(rows: DataFrame) -> DataFrame:
    """The measured rows with low and high, the ends of their band, and kept."""
    ends = small_enough(spool(bands(rows)))  # a row for each language
    width = lambda times: F.coalesce(times * F.col("unit") / F.sqrt("_bytes"), F.lit(LEAST_BAND))
    out = rows.join(ends, F.col("_lang").eqNullSafe(F.col("_of")), "left").withColumn("low", F.col("middle") - width(LOW_WIDTH)).withColumn("high", F.col("middle") + width(HIGH_WIDTH))
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("_of", "middle", "unit", "_bytes")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, log2 perplexity and the band of every document."""
    rows = spool(measured(docs, fit(docs), keep=False))
    return judged(rows).select(F.col("_doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("bits").alias("log2_perplexity"), "low", "high")


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rows = spool(measured(docs, fit(docs), keep=True))
    return judged(rows).where("kept").select(*unpacked(docs))
