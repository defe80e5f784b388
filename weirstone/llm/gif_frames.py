"""GIF media columns: code streams, palettes, disposal and transparency, and timed frames with colour histograms.

A decoder reads any GIF87a or GIF89a: global and local palettes, interlaced rows, transparency, the disposal methods
(leave, clear to background, restore what was before) and delays. Frames come out composed on the canvas.
In a column of codes the width of each code follows from its place since the last clear code alone, so all codes of a stretch are cut
out of the bits at once; and each table entry is a piece of what was put out before, so the table is two lists of numbers.

An encoder stores bytes losslessly as 8-bit samples: a payload becomes frames of WIDTH columns under a grey palette, whose
decoded red channel is the payload. Long payloads take several frames, so no frame's size grows with the text.

Defined cases: a null text counts as empty and is one row of 32s; equal texts have equal values; rows with equal ids are
treated one by one; an empty table gives an empty result; a stream that is cut off gives the frames that are whole, anything else that
is no GIF raises ValueError; columns other than the id and the text are not read by the query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.shared import text_batches, text_of

#: The payload's unit and row, and the most rows of a frame.
WIDTH, FRAME_ROWS = 192, 256
PAD = b" "
#: Hundredths of a second that a stored frame is shown.
DELAY = 10
MOST_BITS = 12
GREY = bytes(v for k in range(256) for v in (k, k, k))


# -- LZW ---------------------------------------------------------------------------------------------------------


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """LZW code stream of samples below 2**bits, least significant bit first; the table is cleared when it is full."""
    clear = 1 << bits
    stop, limit = clear + 1, (1 << MOST_BITS) - 1
    codes: list[int] = []
    put = codes.append
    #: Places of the clear codes among the codes: widths follow from them.
    clears = [0]
    put(clear)
    table: dict[int, int] = {}
    get = table.get
    size = stop + 1
    it = iter(samples)
    prefix = next(it, None)
    if prefix is not None:
        for sample in it:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            prefix = sample
            if size < limit:
                table[key] = size
                size += 1
            else:
                clears.append(len(codes))
                put(clear)
                table.clear()
                size = stop + 1
        put(prefix)
    put(stop)
    return _pack(np.array(codes, np.uint32), _encoder_widths(len(codes), np.array(clears), bits))


def _encoder_widths(n: int, clears: np.ndarray, bits: int) -> np.ndarray:
    """Width of each code: the clear code's own is that of the stretch before it."""
    ends = np.append(clears[1:] + 1, n)
    starts = np.append(0, clears[1:] + 1)
    out = np.empty(n, np.int64)
    ladder = _ladder(bits, int((ends - starts).max()) + 2)
    for k, (b, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        # the first stretch begins with its clear code, later ones after it
        out[b:e] = ladder[: e - b] if k else np.append(bits + 1, ladder[: e - b - 1])
    return out


def _ladder(bits: int, n: int) -> np.ndarray:
    """Width of the k-th code after a clear code."""
    k = np.arange(n)
    size = (1 << bits) + 2 + np.maximum(k - 1, 0)  # entries the decoder has when it reads the code
    return np.clip(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) + 1, bits + 1, MOST_BITS)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths as bits, the least significant first."""
    ends = np.cumsum(widths)
    begin = ends - widths
    out = np.zeros((int(ends[-1]) >> 3) + 4, np.uint32)
    wide = codes << (begin & 7).astype(np.uint32)
    at = begin >> 3
    for k in range(3):
        np.bitwise_or.at(out, at + k, wide >> np.uint32(8 * k) & np.uint32(255))
    return out[: -(-int(ends[-1]) // 8)].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, n: int) -> bytes:
    """The first n samples of a code stream; fewer if it ends before."""
    clear = 1 << bits
    stop = clear + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    wide = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16)
    total = 8 * len(data)
    out = bytearray()
    at = 0
    room = (1 << MOST_BITS) + 2
    ladder = _ladder(bits, room)
    edges = np.concatenate(([0], np.cumsum(ladder)))
    while at < total and len(out) < n:
        # one stretch: up to the next clear code; codes beyond the ladder all have the full width
        codes: list[int] = []
        ended = False
        begin, steps, first = at, edges, True
        while not ended:
            k = int(np.searchsorted(begin + steps[1:], total, "right"))
            if not k:
                break
            places = begin + steps[:k]
            widths = np.diff(steps[: k + 1])
            some = wide[places >> 3] >> (places & 7).astype(np.uint32) & ((np.uint32(1) << widths.astype(np.uint32)) - np.uint32(1))
            marks = np.flatnonzero((some == clear) | (some == stop))
            if len(marks):
                m = int(marks[0])
                codes.extend(some[:m].tolist())
                at = begin + int(steps[m + 1])
                if some[m] == stop:
                    at = total
                ended = True
            else:
                codes.extend(some.tolist())
                begin += int(steps[k])
                if k < len(steps) - 1:
                    break
                steps = np.arange(0, MOST_BITS * room, MOST_BITS)
        if not ended:
            at = total
        _expand(codes, clear, out, n)
    return bytes(out[:n])


def _expand(codes: list[int], clear: int, out: bytearray, n: int) -> None:
    """Put out the samples of one stretch of codes. Entry k of the table is the piece of the output that the k-th code gave, and one more."""
    first_free = clear + 2
    start: list[int] = []
    length: list[int] = []
    add_start, add_length = start.append, length.append
    at = len(out)
    for code in codes:
        if code < clear:
            out.append(code)
            add_start(at)
            add_length(2)
            at += 1
            continue
        k = code - first_free
        if k >= len(start) or k < 0:
            raise ValueError("a code beyond the table")
        b, size = start[k], length[k]
        add_start(at)
        add_length(size + 1)
        if b + size <= at:
            out += out[b : b + size]
        else:  # the entry being made just now: its last sample is its own first
            out += out[b:at]
            out.append(out[b])
        at += size
        if at >= n:
            return


# -- the container ---------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """A composed picture: RGB bytes (height, width, 3), when it begins and how long it is shown, in hundredths of a second."""

    rgb: np.ndarray
    begin: int
    delay: int
    box: tuple[int, int, int, int]

    def histogram(self, bins: int = 4) -> np.ndarray:
        """Pixels by colour cell, bins for each channel."""
        cell = (self.rgb.astype(np.uint16) * bins >> 8).reshape(-1, 3)
        return np.bincount(cell[:, 0] * bins * bins + cell[:, 1] * bins + cell[:, 2], minlength=bins**3)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks from here, and where they end."""
    found = []
    while at < len(data) and (n := data[at]):
        found.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(found), at + 1


def _palette(data: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((256, 3), np.uint8)
    out[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
    return out


def decode(data: bytes) -> Iterator[Frame]:
    """The composed frames of a GIF one by one; only the canvas and what a frame restores are kept."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("these bytes are no GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        if len(data) < at + 3 * n:
            raise ValueError("the palette is cut off")
        shared = _palette(data, at, n)
        at += 3 * n
    ground = shared[background] if shared is not None else np.zeros(3, np.uint8)
    canvas = np.zeros((height, width, 3), np.uint8)
    canvas[:] = ground
    dispose, delay, clear_index, clock = 0, 0, -1, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1] if at + 1 < len(data) else 0
            body, end = _blocks(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                dispose, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else -1
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        if at + 11 > len(data):
            return
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if local & 0x80:
            n = 2 << (local & 7)
            if len(data) < at + 3 * n + 1:
                return
            palette = _palette(data, at, n)
            at += 3 * n
        stream, end = _blocks(data, at + 1)
        samples = lzw_decode(stream, data[at], w * h)
        at = end
        if len(samples) < w * h:
            return
        picture = np.frombuffer(samples, np.uint8).reshape(h, w)
        if local & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(picture)
            straight[order] = picture
            picture = straight
        before = canvas.copy() if dispose == 3 else None
        rows, columns = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        seen = picture[: max(0, height - top), : max(0, width - left)]
        colours = (palette if palette is not None else np.frombuffer(GREY, np.uint8).reshape(-1, 3))[seen]
        if clear_index >= 0:
            drawn = seen != clear_index
            canvas[rows, columns][drawn] = colours[drawn]
        else:
            canvas[rows, columns] = colours
        yield Frame(canvas.copy(), clock, delay, (left, top, w, h))
        clock += delay
        if dispose == 2:
            canvas[rows, columns] = ground
        elif before is not None:
            canvas = before
        dispose, delay, clear_index = 0, 0, -1


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF89a whose frames hold the payload row by row as palette numbers; its length is a positive multiple of the width."""
    if not payload or len(payload) % width:
        raise ValueError("the payload is no positive number of whole rows")
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        stream = lzw_encode(part)
        out.extend(bytes((len(stream[k : k + 255]),)) + stream[k : k + 255] for k in range(0, len(stream), 255))
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """The text filled up with spaces to a positive multiple of the unit."""
    return text + PAD * (-len(text) % unit if text else unit)


# -- columns -----------------------------------------------------------------------------------------------------------


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text stored as a GIF."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array((encode(payload_of(t)) for t in texts), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def frames(media: DataFrame, key_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame of a media column: key, number, begin and delay, size, RGB bytes and the 64-cell colour histogram."""
    text_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for k, f in enumerate(decode(data)) if data is not None else ():
                    h, w, _ = f.rgb.shape
                    row = [key.as_py(), k, f.begin, f.delay, w, h, f.rgb.tobytes(), f.histogram().tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (batch.schema.types[0], pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], ["key", "frame", "begin", "delay", "width", "height", "rgb", "histogram"])

    kind = media.schema[key_col].dataType.simpleString()
    rows = media.select(F.col(key_col).alias("key"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"key {kind}, frame int, begin bigint, delay int, width int, height int, rgb binary, histogram array<bigint>").withColumnRenamed("key", key_col)


def digests(media: DataFrame) -> DataFrame:
    """From the stored bytes of with_media(): what the decoded payload and frames come to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                sha, size, tail, shown, n, cells = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, np.int64)
                for f in decode(data):
                    _, _, w, h = f.box
                    part = np.ascontiguousarray(f.rgb[:h, :w, 0]).tobytes()
                    sha.update(part)
                    size += len(part)
                    tail = (tail + part)[-16:]
                    shown, n = f.begin + f.delay, n + 1
                    cells += f.histogram()
                seen = np.flatnonzero(cells)
                feature = f"frames={n};hundredths={shown};" + ",".join(f"{c}:{cells[c]}" for c in seen)
                out.append((size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
