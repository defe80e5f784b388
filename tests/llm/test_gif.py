"""GIF streams, containers and the media query."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tests.llm.conftest import awkward, by_id
from weirstone.llm import gif_frames as gif


def test_code_streams_round_trip():
    rng = random.Random(4)
    for _ in range(400):
        bits, n = rng.choice([2, 3, 5, 8]), rng.choice([0, 1, 5, 300, 9000])
        most = min(rng.choice([1, 2, 256]), 1 << bits)
        data = bytes(rng.randrange(most) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def slow_decode(data, bits, n):
    """Code by code, with a table of strings."""
    out, clear = bytearray(), 1 << bits
    value = int.from_bytes(data, "little")
    table, width, at, before = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, 0, None
    while at + width <= 8 * len(data) and len(out) < n:
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, before = table[: clear + 2], bits + 1, None
            continue
        if code == clear + 1:
            break
        if before is None:
            own = table[code]
        else:
            own = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + own[:1])
        out += own
        before = own
        if len(table) == 1 << width and width < 12:
            width += 1
    return bytes(out[:n])


def test_a_full_table_without_clear_is_read():
    """Encoders may go on with a full table; codes are packed here by hand."""
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 256, 6000)
    codes = np.concatenate(([256], samples, [257])).astype(np.uint32)
    widths = np.concatenate(([9], gif._ladder(8, 6001)))
    data = gif._pack(codes, widths)
    assert gif.lzw_decode(data, 8, 6000) == samples.astype(np.uint8).tobytes() == slow_decode(data, 8, 6000)


def test_random_streams_agree_with_the_slow_way():
    rng = random.Random(5)
    for _ in range(50):
        data = bytes(rng.choice([1, 2, 3, 200]) for _ in range(rng.randrange(5000)))
        stream = gif.lzw_encode(data)
        assert slow_decode(stream, 8, len(data)) == data
        cut = stream[: len(stream) // 2]
        assert gif.lzw_decode(cut, 8, len(data)) == slow_decode(cut, 8, len(data))
    with pytest.raises(ValueError, match="table"):
        gif._expand([65, 400], 256, bytearray(), 10)


def image(left, top, w, h, samples, interlaced=False, palette=None):
    flags = 0x40 * interlaced | (0x80 if palette else 0)
    stream = gif.lzw_encode(bytes(samples), 2)
    return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (palette or b"") + b"\x02" + bytes([len(stream)]) + stream + b"\0"


def control(dispose, delay, clear=None):
    return b"\x21\xf9\x04" + bytes([dispose << 2 | (clear is not None)]) + struct.pack("<H", delay) + bytes([clear or 0, 0])


COLOURS = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
HEAD = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 3, 0) + COLOURS
RED, GREEN, BLUE, GROUND = [255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9]


def shown(data):
    return [f.rgb.reshape(-1, 3).tolist() for f in gif.decode(data)]


def test_palettes_transparency_and_delays():
    data = HEAD + control(1, 5) + image(0, 0, 2, 2, [0, 1, 2, 0]) + b"\x21\xfe\x02hi\0" + control(1, 7, 1) + image(0, 0, 2, 1, [1, 2]) + b"\x3b"
    assert shown(data) == [[RED, GREEN, BLUE, RED], [RED, BLUE, BLUE, RED]]
    assert [(f.begin, f.delay) for f in gif.decode(data)] == [(0, 5), (5, 7)]
    local = HEAD + image(0, 0, 1, 1, [1], palette=bytes(6)) .replace(struct.pack("<HHHHB", 0, 0, 1, 1, 0x80), struct.pack("<HHHHB", 0, 0, 1, 1, 0x80)) + b"\x3b"
    assert shown(local)[0][0] == [0, 0, 0]


def test_disposal():
    first, second = image(0, 0, 2, 2, [0] * 4), image(1, 0, 1, 1, [2])
    third = image(0, 1, 1, 1, [1])
    for dispose, left in ((1, BLUE), (2, GROUND), (3, RED)):
        data = HEAD + first + control(dispose, 0) + second + third + b"\x3b"
        assert shown(data)[2] == [RED, left, GREEN, RED]


def test_interlaced_rows_and_clipped_frames():
    head = b"GIF87a" + struct.pack("<HHBBB", 1, 8, 0x81, 3, 0) + COLOURS
    assert [p[0] for p in shown(head + image(0, 0, 1, 8, [0, 1, 2, 2, 3, 3, 3, 3], True) + b"\x3b")[0]] == [255, 9, 0, 9, 0, 9, 0, 9]
    assert shown(HEAD + image(1, 1, 2, 2, [1] * 4) + b"\x3b")[0] == [GROUND, GROUND, GROUND, GREEN]


def test_broken_streams():
    good = HEAD + image(0, 0, 2, 2, [0] * 4) + image(0, 0, 2, 2, [1] * 4) + b"\x3b"
    assert len(list(gif.decode(good[:-6]))) == 1
    for bad in (b"", b"PNG", HEAD[:15], HEAD + b"\x99"):
        with pytest.raises(ValueError):
            list(gif.decode(bad))
    with pytest.raises(ValueError):
        gif.encode(b"x")


def test_payloads_of_many_frames():
    data = gif.payload_of(bytes(range(256)) * 500)
    frames = list(gif.decode(gif.encode(data)))
    assert len(frames) == 3 and b"".join(f.rgb[: f.box[3], :, 0].tobytes() for f in frames) == data
    assert gif.payload_of(b"") == b" " * 192 and len(gif.payload_of(b"x" * 192)) == 192


def test_query(docs, nothing, crowded):
    want = []
    for key, text, *_ in awkward():
        b = (text or "").encode()
        p = gif.payload_of(b)
        want.append((key, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"]
    for df in (docs, crowded):
        media = gif.with_media(df)
        assert by_id(gif.digests(media).select(names).collect()) == by_id(want)
    rows = gif.digests(gif.with_media(docs)).collect()
    assert len({(r.payload_sha256, r.media_sha256, r.feature, r.media_bytes) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert gif.digests(gif.with_media(nothing)).collect() == []
    frames = gif.frames(gif.with_media(docs.where("doc_id = 106")), "doc_id")
    assert [(r.frame, r.begin, sum(r.histogram) == r.width * r.height) for r in frames.collect()] == [(0, 0, True)]
