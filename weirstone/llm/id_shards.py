"""Token ids in binary shards: one zstandard frame for each document under a dictionary that all shards share.

File format (little-endian). A set of shards is one table in the shared folder with a row for each shard; the bytes of a
shard stand by themselves and can be put into files with export_files().

    0   8 bytes   magic "WSIDS001"
    8   32 bytes  sha256 of the zstandard dictionary
    40  u32       bytes of an id: 2 or 4
    44  u32       documents n
    48  u64       ids in the bucket before this shard
    56  i64[n]    document ids; u8[n] 1 where the id is null
        u64[n+1]  offsets of the frames after the index; u64[n] number of ids
        frames    each document's ids, compressed on their own

A document is read by looking its id up in the index and decompressing one frame. Shards are in ascending order of doc_id
(null first, equal ids by their frames): buckets are ranges of doc_id, and within a bucket one sorted task writes them. An id, or no id, that has
more rows than a bucket should gets several buckets, over which its rows are dealt by a checksum of their frames, which orders them before the frames do.

The dictionary is trained on a bounded sample of documents (SAMPLE_DOCS of at most SAMPLE_BYTES characters, those with the least hashes, so the
files don't depend on how the table is partitioned); every document is encoded, compressed and indexed whatever the sample holds. The trainer needs
LEAST_SAMPLES samples that differ: with fewer, or where it finds nothing that they share, the set has an empty dictionary and plain frames.

Defined cases: a null text counts as empty and has the end id alone; repeated rows are kept as they are; an empty table gives an
empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstone.llm.shared import parts, sliced, text_batches, text_of, work_folder

MAGIC = b"WSIDS001"
HEAD = struct.Struct("<8s32sIIQ")
#: The sample that the dictionary is trained on, and the dictionary's own size.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEAST_SAMPLES = 2_000, 16_384, 65_536, 16
LEVEL = 3
#: A shard ends beyond so many bytes of frames.
SHARD_BYTES = 4 << 20
#: Ranges of doc_id: a few for each task; the driver keeps one number for each.
MOST_BUCKETS = 65_536
#: Words whose ids a task keeps at once.
KEPT_WORDS = 800_000
KEPT_CHARS = 64
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
NO_ID = np.iinfo(np.int64).min


def _byte_chars() -> list[str]:
    """The character that byte-level models have for each byte: itself if it is printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


BYTE_CHARS = _byte_chars()


class Kept(dict):
    """A bounded table that makes what it lacks."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        value = self.make(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


class WordIds:
    """Encodes with a tokenizers file; where its rules can't look over a space, words are encoded once and kept."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.by_word = self._within_words(spec)
        code = "H" if self.width == 2 else "I"
        self.pack = lambda ids: array(code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, f"<u{self.width}").tobytes()
        self.model = self.library.model
        self.words, self.stems = Kept(self._word), Kept(self._stem)
        self.tails = dict(zip(",.", self._bytes([",", "."]), strict=True))

    @staticmethod
    def _within_words(spec: dict) -> bool:
        """True if no rule of the file sees both sides of a space or a line end."""
        normaliser, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = {(x["type"], json.dumps(x.get("pattern")), x.get("content")) for x in normaliser.get("normalizers", [])}
        safe = {("NFC", "null", None), ("Lowercase", "null", None), ("Replace", json.dumps({"Regex": "\\s+"}), " ")}
        first = (splitter.get("pretokenizers") or [{}])[0]
        return (
            steps <= safe
            and first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and bool(first.get("invert"))
            and first["pattern"].get("Regex", " ").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
            and [x["type"] for x in splitter["pretokenizers"][1:]] == ["ByteLevel"]
            and {x["type"] for x in normaliser.get("normalizers", [])} == {"NFC", "Lowercase", "Replace"}
            and spec["model"]["type"] == "BPE"
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(" \n") for x in spec["added_tokens"])
        )

    def _bytes(self, texts: list[str]) -> list[bytes]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        at = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
        data = np.fromiter(chain.from_iterable(found), f"<u{self.width}", at[-1]).tobytes()
        at = (at * self.width).tolist()
        return [data[b:e] for b, e in pairwise(at)]

    def _stem(self, stem: str) -> bytes:
        """Ids of a Latin word in lower case, from the model alone."""
        chars = stem if stem.isascii() else "".join(map(BYTE_CHARS.__getitem__, stem.encode()))
        return self.pack([t.id for t in self.model.tokenize(chars)])

    def _word(self, word: str) -> bytes:
        """Ids of a word. A Latin word with or without a comma or full stop is cut as the file's own pattern does and put into
        lower case; all others go the library's whole way."""
        tail = self.tails.get(word[-1], b"")
        stem = (word[:-1] if tail else word).lower()
        if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):  # no marks, and nothing that composes
            return self.stems[stem] + tail
        return self._bytes([word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, serialised."""
        if not self.by_word:
            return self._bytes(texts)
        get = self.words.__getitem__
        # split() also splits at four control characters that are no white space for the file's pattern
        return [b"".join(map(get, [w for w in t.replace("\n", " ").split(" ") if w] if any(c in t for c in CONTROLS) else t.split())) for t in texts]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One encoder for each file and worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from the serialised ids of a bounded sample; empty if there is too little to learn from."""
    step = max(1, docs.count() // SAMPLE_DOCS)
    text = text_of(text_col)
    order = F.xxhash64(F.col(id_col).cast("bigint"), text)
    few = docs.where(F.length(text) <= SAMPLE_BYTES).select(text.alias("text"), order.alias("order")).where(F.pmod("order", F.lit(step)) == 0).orderBy("order", "text").limit(SAMPLE_DOCS).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder(tokenizer).encode(batch.column(0).to_pylist()), pa.binary())], ["ids"])

    samples = sorted(bytes(r.ids) for r in few.mapInArrow(run, "ids binary").collect() if len(r.ids) >= 16)
    if len(samples) < LEAST_SAMPLES:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:  # too uniform to learn from
        return b""


def _shard(dictionary: bytes, width: int, before: int, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    keys = np.array([NO_ID if k is None else k for k, _, _ in rows], "<i8")
    null = np.array([k is None for k, _, _ in rows], np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(f) for _, _, f in rows]))).astype("<u8")
    head = HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width, len(rows), before)
    return b"".join([head, keys.tobytes(), null.tobytes(), offsets.tobytes(), np.array([n for _, n, _ in rows], "<u8").tobytes(), *(f for _, _, f in rows)])


class Shard:
    """Reads documents of one shard by their place or id."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, digest, self.width, n, self.before = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("these bytes are no shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = HEAD.size
        self.keys = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(data, "<u8", n, at + 17 * n + 8)
        self.frames = memoryview(data)[at + 25 * n + 8 :]
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document: one frame is decompressed."""
        frame = self.frames[int(self.offsets[k]) : int(self.offsets[k + 1])]
        return np.frombuffer(self.unpack(frame, max_output_size=int(self.counts[k]) * self.width), f"<u{self.width}")

    def find(self, key: int) -> range:
        """Places of the documents with this id."""
        known = self.keys[int(self.null.sum()) :]
        b, e = (int(np.searchsorted(known, key, side)) + int(self.null.sum()) for side in ("left", "right"))
        return range(b, e)


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, bytes]:
    """Encode all documents into shards below a new shared folder; returns the folder and the dictionary."""
    spark = docs.sparkSession
    text_batches(spark)
    dictionary = train_dictionary(docs, tokenizer, id_col, text_col)
    n = min(MOST_BUCKETS, 4 * parts(spark))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(NO_ID)))
    cuts = np.array(sorted(docs.select(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n).alias("at")).first().at or []), np.int64)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False, write_content_size=True).compress
        end = np.array([end_id], f"<u{own.width}").tobytes()
        for batch in batches:
            keys = batch.column(0)
            ids = [x + end for x in own.encode(batch.column(1).to_pylist())]
            frames = [pack(x) for x in ids]
            low, high = (np.searchsorted(cuts, keys.fill_null(int(NO_ID)).to_numpy(), side) for side in ("left", "right"))
            several = np.flatnonzero(high - low > 1)  # an id that two cuts or more fall on: after all of these but the last no other id comes
            high[several] = low[several] + 1 + np.array([zlib.crc32(frames[k]) for k in several], np.int64) % (high - low)[several]
            yield pa.RecordBatch.from_arrays([pa.array(high, pa.int32()), keys, pa.array([len(x) // own.width for x in ids], pa.int64()), pa.array(frames, pa.binary())], ["bucket", "key", "n", "frame"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, rows, size, seen, bucket, shards = encoder(tokenizer).width, [], 0, 0, None, 0

        def out() -> pa.RecordBatch:
            data = _shard(dictionary, width, seen, rows)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([shards], pa.int32()), pa.array([sum(n for _, n, _ in rows)], pa.int64()), pa.array([data], pa.binary())], ["bucket", "shard", "n", "data"])

        for batch in batches:
            for b, key, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (b != bucket or size > SHARD_BYTES):
                    yield out()
                    seen, shards = (seen + sum(n for _, n, _ in rows), shards + 1) if b == bucket else (0, 0)
                    rows, size = [], 0
                bucket = b
                rows.append((key, n, frame))
                size += len(frame)
        if rows:
            yield out()

    frames = docs.select(F.col(id_col).cast("bigint").alias("key"), text_of(text_col).alias("text")).mapInArrow(compress, "bucket int, key bigint, n bigint, frame binary")
    shards = frames.repartition(parts(spark), "bucket").sortWithinPartitions("bucket", "key", "frame").mapInArrow(gather, "bucket int, shard int, n bigint, data binary")
    folder = work_folder(spark)
    shards.write.option("compression", "none").parquet(folder)
    return folder, dictionary


def read(spark: SparkSession, folder: str, dictionary: bytes) -> DataFrame:
    """From the shards: doc_id, start, n_tokens and ids_crc32 of every document."""
    table = spark.read.parquet(folder)
    text_batches(spark)
    totals = sorted((r.bucket, r.n) for r in table.groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # a row for each bucket
    sums = np.concatenate(([0], np.cumsum([n for _, n in totals], dtype=np.int64)))
    bases = {b: int(s) for (b, _), s in zip(totals, sums, strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                shard = Shard(batch.column(1)[0].as_py(), dictionary)
                counts = shard.counts.astype(np.int64)
                starts = bases[batch.column(0)[0].as_py()] + shard.before + np.cumsum(counts) - counts
                crc = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(counts))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64(), mask=shard.null), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("bucket", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def export_files(spark: SparkSession, folder: str, to: str) -> int:
    """Put the shards of a set into plain files of a local folder, named in document order; returns their number."""
    from pathlib import Path

    n = 0
    for row in spark.read.parquet(folder).orderBy("bucket", "shard").toLocalIterator():
        Path(to, f"ids-{n:08d}.wsids").write_bytes(bytes(row.data))
        n += 1
    return n
