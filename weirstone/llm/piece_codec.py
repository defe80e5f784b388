"""SentencePiece encoding and decoding that keeps the original byte span of every piece.

A text is first normalised as the model says: at each place the longest key of the compiled character
map is replaced, and every normalised byte remembers the original byte span it came from. The
library then encodes the text, and each piece is projected through that alignment onto the original.

The library call is exact but slow on whole texts. No merge of a BPE model crosses from a word into the next
space mark unless the vocabulary has a piece with an inner space mark. The vocabulary is looked through
for such pieces once; without them equal words have equal pieces, so the pieces of a word are kept in a
bounded table and the library only sees words that the table lacks.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; rows with equal
doc_id are encoded one by one; other columns are not read by the query; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from weirstone.llm.shared import text_batches, text_of

#: Fixed value: the mark that stands for a space inside pieces.
SPACE = "▁"
#: Words whose pieces a task keeps at once; the table starts anew beyond it.
KEPT_WORDS = 400_000
#: Longest word that is kept, in characters.
KEPT_CHARS = 64


class CharacterMap:
    """The compiled map of a model: a double-array trie of UTF-8 keys and the pool of their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at this byte, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._child_base(0, units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[n]:  # the label, with the bit that marks a value
                break
            node = self._child_base(node, unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (n + 1 - at, self.pool[value : self.pool.index(b"\0", value)])
        return found

    @staticmethod
    def _child_base(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 0x200) >> 6))


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class PieceCodec:
    """Encodes with a SentencePiece model file and says which original bytes each piece stands for."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.spec = model.normalizer_spec
        self.map = CharacterMap(self.spec.precompiled_charsmap)
        kinds = model_pb.ModelProto.SentencePiece
        self.byte_ids = {i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = self.library.unk_id()
        self.pieces = [p.piece.encode() for p in model.pieces]
        marks = {p.piece for p in model.pieces if p.type == kinds.USER_DEFINED}
        self.by_word = (
            model.trainer_spec.model_type == model_pb.TrainerSpec.BPE
            and not self.spec.precompiled_charsmap
            and not self.spec.remove_extra_whitespaces
            and self.spec.add_dummy_prefix
            and self.spec.escape_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not marks
            and not any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        )
        self.marks = sorted((m.encode() for m in marks), key=len, reverse=True)
        self.by_word = self.by_word and model.trainer_spec.byte_fallback  # else unknown pieces have any length
        self.lengths = np.array([1 if i in self.byte_ids else len(p) for i, p in enumerate(self.pieces)], "<u2")
        self.words: dict[str, tuple[bytes, bytes]] = {}

    # -- normalisation -------------------------------------------------------------------------------

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each of them the original start and end of what it came from."""
        mark = SPACE.encode() if self.spec.escape_whitespaces else b" "
        squeeze = self.spec.remove_extra_whitespaces
        if not (squeeze or self.marks or self.map.units):
            return self._normalise_spaces(data, mark)
        out, begin, end, steps, at = bytearray(), [], [], [], 0

        def put(new: bytes, b: int, e: int) -> None:
            """A changed byte stands for all it came from, an unchanged one for itself."""
            same = new == data[b:e]
            begin.extend(range(b, e) if same else [b] * len(new))
            end.extend(range(b + 1, e + 1) if same else [e] * len(new))
            out.extend(new)

        while at < len(data):
            user = next((m for m in self.marks if data.startswith(m, at)), None)
            if user is not None:
                n, new = len(user), user
            elif (found := self.map.longest(data, at)) is not None:
                n, new = found
            else:
                n = _char_bytes(data[at])
                new = data[at : at + n]
            steps.append((new, at, at + n))
            at += n
        if squeeze:
            while steps and steps[0][0] in (b"", b" "):
                steps.pop(0)
        if not steps:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.spec.add_dummy_prefix:
            put(mark, steps[0][1], steps[0][1])
        after_space = squeeze
        for new, b, e in steps:
            if squeeze and after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = squeeze and new.endswith(b" ")
                put(new.replace(b" ", mark), b, e)
        if squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], begin[-len(mark) :], end[-len(mark) :]
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def _normalise_spaces(self, data: bytes, mark: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The case without a map: only spaces change."""
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.repeat(np.arange(len(data)), np.where(np.frombuffer(data, np.uint8) == 32, len(mark), 1))
        end = begin + 1
        new = data.replace(b" ", mark)
        if self.spec.add_dummy_prefix:
            zeros = np.zeros(len(mark), np.int64)
            new, begin, end = mark + new, np.concatenate((zeros, begin)), np.concatenate((zeros, end))
        return new, begin, end

    def _lengths(self, ids: list[int], normalised: bytes) -> list[int]:
        """Normalised bytes that each piece covers; an unknown piece covers what lies before the next known one."""
        lengths, at = [], 0
        for k, i in enumerate(ids):
            if i in self.byte_ids:
                n = 1
            elif i != self.unknown:
                n = len(self.pieces[i])
            elif k + 1 == len(ids):
                n = len(normalised) - at
            else:
                nxt = self.pieces[ids[k + 1]]
                n = max(_char_bytes(normalised[at]), normalised.find(nxt, at + 1) - at)
            lengths.append(n)
            at += n
        return lengths

    # -- encoding -------------------------------------------------------------------------------------

    def encode_whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, span starts and span ends of one text by the general way: map, encode, project."""
        ids = self.library.encode(text)
        normalised, begin, end = self.normalise(text.encode())
        stops = np.cumsum(self._lengths(ids, normalised), dtype=np.int64)
        if not len(stops):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.concatenate(([0], stops[:-1]))
        return np.array(ids, np.int32), begin[starts], end[np.maximum(stops - 1, starts)]

    def _learn(self, words: Iterable[str]) -> dict[str, tuple[bytes, bytes]]:
        """Pieces of words that begin with a space: ids as int32 and original lengths as uint16, both little-endian.

        The library puts one space mark before what it gets, so a word is handed over without its space. The
        space is one original byte, its mark three normalised ones; all other bytes of a word stand for themselves.
        """
        order = list(words)
        found = self.library.encode([w[1:] for w in order], num_threads=1)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64)))
        ids = np.fromiter((i for x in found for i in x), "<i4", bounds[-1])
        lengths = self.lengths[ids]
        lengths[bounds[:-1]] -= 2
        ids, lengths, at = ids.tobytes(), lengths.tobytes(), bounds.tolist()
        return {w: (ids[4 * b : 4 * e], lengths[2 * b : 2 * e]) for w, b, e in zip(order, at, at[1:], strict=False)}

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, span starts and span ends in original bytes."""
        if not self.by_word:
            yield from map(self.encode_whole, texts)
            return
        split = []
        for text in texts:
            words = text.split(" ")
            # runs of spaces have pieces of their own, and very long words would fill the table
            plain = text and "\0" not in text and SPACE not in text and "" not in words and max(map(len, words)) <= KEPT_CHARS
            split.append([" " + w for w in words] if plain else None)
        missing = {w for words in split if words for w in words if w not in self.words}
        if len(self.words) + len(missing) > KEPT_WORDS:
            self.words.clear()
            missing = {w for words in split if words for w in words}
        self.words.update(self._learn(missing))
        get = self.words.__getitem__
        for text, words in zip(texts, split, strict=True):
            if words is None:
                yield self.encode_whole(text)
                continue
            ids, lengths = zip(*map(get, words), strict=True)
            stops = np.cumsum(np.frombuffer(b"".join(lengths), "<u2"), dtype=np.int64) - 1  # the first space is the dummy
            starts = np.concatenate(([0], stops[:-1]))
            yield np.frombuffer(b"".join(ids), "<i4"), np.maximum(starts, 0), np.maximum(stops, 0)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model and worker process."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids, and the byte span [begin, end) of each id in the original text."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            found = list(own.encode(batch.column(1).to_pylist()))
            ids, begin, end = (pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, begin, end], ["key", "ids", "begin", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, begin array<bigint>, end array<bigint>").withColumnRenamed("key", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """Per row: id and the text that its ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(batch.column(1).to_pylist()), pa.string())], ["key", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("key"), "ids").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", id_col)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: what encode() and decode() of it come to, without moving the ids to the JVM.

    spans_crc32 is over the span starts and then the ends as little-endian int64; n_spanned counts the original bytes inside spans.
    """
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            found = list(own.encode(batch.column(1).to_pylist()))
            lists = [f[0].tolist() for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in lists]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in own.decode(lists)]),
                    pa.array([int(e.max() - b.min()) if len(b) else 0 for _, b, e in found], pa.int64()),
                    pa.array([zlib.crc32(e.tobytes(), zlib.crc32(b.tobytes())) for _, b, e in found], pa.int64()),
                ],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned", "spans_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_spanned bigint, spans_crc32 bigint")
    return out.withColumnRenamed("key", id_col)


def piece_starting_at(begin: list[int], byte: int) -> int:
    """Index of the last piece that starts at or before a byte: the way from a place in the text to its token."""
    return bisect_right(begin, byte) - 1
