"""Removal of repeated byte strings with a run-length index of the places where repeats can be.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in whatever document. Strings never cross documents.

1. Anchors. In each string of LENGTH bytes the GRAM bytes with the least hash are its anchor (of equals, the first), a function of the
   string alone, so equal strings have equal anchors at equal offsets. Strings that start side by side mostly share one;
   the bytes that the strings of an anchor cover are its context. One row for each anchor is shuffled by the anchor's hash.
2. An anchor that occurs once has no repeat. Equal contexts are one entry of the collection with a weight: the runs that a
   Burrows-Wheeler transform of the collection would make of them are made beforehand. Where all contexts of an anchor are
   equal their strings are repeated as a whole.
3. Where contexts of one anchor differ, they are fetched and indexed: batches of anchors give one run-compressed Burrows-Wheeler
   transform each, with samples at the ends of its runs. Every context is streamed backwards through it by LF steps
   over the runs, from its end to its start, which gives its matching statistics (how far the bytes from each place on occur elsewhere) out of the samples alone;
   a match of LENGTH bytes or more is marked.
4. An anchor with more than GROUP_BYTES of different contexts isn't indexed in one task. Its contexts are cut in two halves by
   the offset of the anchor in the string; each half's strings share some more bytes, which are hashed into the
   key, and the halves are settled in another round. After a few rounds a context is one string, and equal ones are one entry
   of which a task holds one.
5. The marked intervals go back to the documents, which lie in a table bucketed by row: texts are shuffled once, in the beginning.

Defined cases: a null text counts as empty; texts shorter than LENGTH lose nothing; repeated rows are copies of each other and lose all bytes if they
have LENGTH of them; null ids are kept; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.shared import byte_views, parts, run_bounds, spool, text_batches, text_of, work_folder

LENGTH, GRAM = 200, 48
SPREAD = LENGTH - GRAM + 1  # places of an anchor in a string
#: Bytes of text that anchors are looked for in at once, of one index, and of the contexts of one anchor that share a task.
BLOCK_BYTES, INDEX_BYTES, GROUP_BYTES = 512 << 10, 512 << 10, 1 << 20
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PACKED = 7  # characters of nine bits that a first sort looks at
PLACE_BITS = 28  # of a place in a block; the other bits hold the hash that is compared
CONTEXT = [("key", pa.int64()), ("ctx", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("off", pa.int32()), ("size", pa.int32()), ("weight", pa.int32())]
#: Weights of context rows: seen once, seen more often in the task that found it, and no context but a repeated interval.
ONCE, OFTEN, MARK = 1, 2, 3


# -- anchors ----------------------------------------------------------------------------------------------------------


class _Powers:
    """Powers of the multiplier and of its inverse, as far as they were needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            full = np.full(n, BASE, np.uint64)
            full[0] = 1
            cls.up = np.multiply.accumulate(full)
            full[1:] = INVERSE
            cls.down = np.multiply.accumulate(full)
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    h = (sums[GRAM:] - sums[:-GRAM]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row: prefix and suffix minima of blocks, combined."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, its place, and the first and last start of the strings that have it; strings lie within documents."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    hashes = gram_hashes(data)
    packed = (hashes & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_min(packed, SPREAD) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[: len(least)])
    place = least[starts]
    bounds = run_bounds(place)
    return hashes[place[bounds[:-1]]], place[bounds[:-1]], starts[bounds[:-1]], starts[bounds[1:] - 1]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """First and last document, begin and end in bytes, of pieces of about so many bytes. A long document is cut so that each string
    of LENGTH bytes starts in just one piece and lies in it: anchors are the strings' own, so cuts don't change them."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= 2 * size:
            yield first, last, begin, end
        else:  # one document alone
            for at in range(begin, end - LENGTH + 1, size):
                yield first, last, at, min(at + size + LENGTH - 1, end)
        first = last


def hashes_of(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys that spread intervals over the tasks."""
    h = (rows.astype(np.uint64) << np.uint64(20)) ^ places.astype(np.uint64)
    return (h * np.uint64(BASE) ^ h >> np.uint64(31)).view(np.int64)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def anchor_rows(table: DataFrame) -> DataFrame:
    """key, ctx, row, at, off, size, weight of every anchor of the rows (_row, _bytes); at and size are those of its context.

    Contexts that a block of text has twice or more are repeated as a whole: one of them goes on for all, and what they cover goes
    on as merged intervals. So a text of one word over and over costs a row, not one for each word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, (data, offsets) = batch.column(0).to_numpy(), byte_views(batch.column(1))
            for first, last, begin, end in blocks(offsets):
                own, shift = data[begin:end], begin - offsets[first]
                cuts = offsets[first : last + 1] - begin if last - first > 1 else np.array([0, end - begin])
                key, place, b, e = anchors(own, cuts)
                doc = np.searchsorted(cuts, b, "right") - 1
                view, digest = memoryview(np.ascontiguousarray(own)), xxhash.xxh3_64_intdigest
                stop = e + LENGTH
                ctx = np.array([digest(view[x:y]) for x, y in zip(b.tolist(), stop.tolist(), strict=True)], np.uint64)
                _, head, group, times = np.unique(ctx, return_index=True, return_inverse=True, return_counts=True)
                often = times[group] > 1
                weight = np.where(often, OFTEN, ONCE)
                keep = np.sort(head)
                columns = [(key.view(np.int64), ctx.view(np.int64), rows[first:last][doc], b - cuts[doc] + shift, place - b, stop - b, weight)]
                columns = [[c[keep] for c in columns[0]]]
                again = np.flatnonzero(often)
                if len(again):
                    bb, ee, dd = b[again], stop[again], doc[again]
                    new = np.append(True, (dd[1:] != dd[:-1]) | (bb[1:] > ee[:-1]))
                    head, tail, of = bb[new], ee[np.append(new[1:], True)], dd[new]
                    lone = hashes_of(rows[first:last][of], head + begin)
                    columns.append([lone, lone, rows[first:last][of], head - cuts[of] + shift, np.zeros(len(head)), tail - head, np.full(len(head), MARK)])
                for c in columns:
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype()), t) for x, (_, t) in zip(c, CONTEXT, strict=True)], [n for n, _ in CONTEXT])

    return table.mapInArrow(run, "key bigint, ctx bigint, row bigint, at bigint, off int, size int, weight int")


def sorted_out(found: DataFrame) -> DataFrame:
    """kind, key, ctx, row, at, off, size: contexts that are repeated as a whole (kind 0), and of anchors with different contexts those that
    occur once (kind 1) and one of each that occurs twice or more (kind 2). Rows come sorted, so each needs its neighbours only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in CONTEXT]
        held: pa.Table | None = None  # the row before (or none), and rows whose next is unknown
        before = False  # whether the held row before belongs to a context that isn't its anchor's first

        def judge(table: pa.Table, lead: bool, final: bool) -> Iterator[pa.RecordBatch]:
            """Judges rows between the first (if lead) and the last (unless final), which are known neighbours only."""
            nonlocal before
            key, ctx, off, size, weight = (table.column(c).to_numpy() for c in ("key", "ctx", "off", "size", "weight"))
            same_key = key[1:] == key[:-1]
            same = same_key & (ctx[1:] == ctx[:-1]) & (off[1:] == off[:-1]) & (size[1:] == size[:-1])
            n = len(key)
            prev_key, next_key = np.append(False, same_key), np.append(same_key, False)
            prev, nxt = np.append(False, same), np.append(same, False)
            # later[i]: the context that i belongs to has another one of its anchor before it
            run = np.cumsum(~prev) - 1
            heads = np.flatnonzero(~prev)
            later = prev_key[heads]
            if lead:
                later[0] = before
            later = later[run]
            whole = prev | nxt | (weight > ONCE)
            once = ~whole & (prev_key | next_key)
            one = whole & ~nxt & (later | next_key) & (weight < MARK)
            mine = np.ones(n, bool)
            mine[0] = not lead
            if not final:
                mine[-1] = False
                before = bool(later[-2]) if n > 1 else before
            for kind, chosen in ((0, whole), (1, once), (2, one)):
                at = np.flatnonzero(chosen & mine)
                if len(at):
                    some = table.take(pa.array(at)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(some.column(c).chunk(0) for c in names[:-1])], ["kind", *names[:-1]])

        lead = False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 3:
                continue
            yield from judge(held, lead, False)
            held, lead = held.slice(held.num_rows - 2), True
        if held is not None and held.num_rows:
            yield from judge(held, lead, True)

    return found.repartition(parts(found.sparkSession), "key").sortWithinPartitions("key", "ctx", "off", "size").mapInArrow(run, "kind int, key bigint, ctx bigint, row bigint, at bigint, off int, size int")


# -- the index ---------------------------------------------------------------------------------------------------------


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of weighted strings, sampled at the ends of its runs.

    Kept are the runs (start, character, LF value) and two samples for each: for the suffixes that LF makes of its first and last row, the place
    of the suffix that is next to it in order, outside the run, and the bytes that both agree on. The suffix order itself is given up. As long as a stream stays
    inside runs its neighbours in order move along with it and agree on one byte more; where it meets an end of a run, the sample there takes over. So
    all matching statistics come from the samples, and there are as many of those as there are runs.
    """

    def __init__(self, strings: list[bytes], weights: list[int]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.weights = np.array(weights, np.int64)
        self.ends = np.cumsum(self.sizes + 1)  # each string is followed by a zero that no other character reaches
        self.starts = self.ends - self.sizes - 1
        text = np.zeros(int(self.ends[-1]), np.int64)
        text[:] = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        text += 1
        text[self.ends - 1] = 0
        self.n = len(text)
        rest = np.repeat(self.ends, self.sizes + 1) - np.arange(self.n)  # characters up to and with the zero
        order, levels = self._sort(text, rest)
        last = text[order - 1]  # the character before each suffix; nothing comes before a string
        last[np.isin(order, self.starts)] = 0
        bounds = run_bounds(last)
        self.run_start, self.run_end, self.run_char = bounds[:-1], bounds[1:] - 1, last[bounds[:-1]]
        count = np.bincount(last, minlength=258)
        # rows of zeros come first, one for each string, whatever precedes it
        first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=258))[:-1])).astype(np.int64)
        by_char = np.argsort(self.run_char, kind="stable")
        width = np.diff(bounds)
        before = np.cumsum(width[by_char]) - width[by_char]
        base = np.concatenate(([0], np.cumsum(count)))[self.run_char[by_char]]
        self.lf = np.empty(len(by_char), np.int64)
        self.lf[by_char] = first[self.run_char[by_char]] + before - base
        self.head_place, self.head_length = self._samples(text, rest, order, levels, self.lf, -1)
        self.tail_place, self.tail_length = self._samples(text, rest, order, levels, self.lf + width - 1, 1)
        m = len(strings)
        #: Where streams begin: the zeros' neighbours in order, with which they agree on nothing.
        self.above_ends = np.append(-1, self.ends[:-1] - 1)
        self.below_ends = np.append(self.ends[1:] - 1, order[m] if m < self.n else -1)

    def _samples(self, text: np.ndarray, rest: np.ndarray, order: np.ndarray, levels: dict[int, np.ndarray], rows: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For the suffix in each row the place of its neighbour and the bytes that they agree on; runs that precede a whole string have none."""
        place, length = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        at = np.flatnonzero((self.run_char > 0) & (rows + side >= 0) & (rows + side < self.n))
        a, b = order[rows[at]], order[rows[at] + side]
        same = np.zeros(len(at), np.int64)
        for step in sorted(levels, reverse=True):  # ranks by the first `step` characters
            x, y = np.minimum(a + same, self.n - 1), np.minimum(b + same, self.n - 1)
            same += np.where(levels[step][x] == levels[step][y], step, 0)
        on = np.ones(len(at), bool)
        for _ in range(PACKED - 1):
            on &= text[np.minimum(a + same, self.n - 1)] == text[np.minimum(b + same, self.n - 1)]
            same += on
        place[at], length[at] = b, np.minimum(same, np.minimum(rest[a], rest[b]) - 1)
        return place, length

    @staticmethod
    def _sort(text: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Suffix order by doubling, equal suffixes in the order of their strings, and the ranks of each doubling by the characters that it has seen."""
        n, most, have = len(text), int(rest.max()), PACKED
        key = np.zeros(n, np.int64)
        for k in range(have):
            key <<= 9
            inside = max(n - k, 0)
            key[:inside] |= np.where(rest[:inside] > k, text[k:], 0)
        levels: dict[int, np.ndarray] = {}
        while True:
            order = np.argsort(key)
            step = np.append(False, key[order[1:]] != key[order[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            levels[have] = rank
            if have >= most:
                return np.argsort(rank * n + np.arange(n)), levels
            key = rank * (n + 1)
            inside = np.flatnonzero(rest > have)
            key[inside] += rank[inside + have] + 1
            have *= 2

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the collection (a string begins at starts[k]) how many bytes from there on occur at another place too, and
        that place. All strings are streamed backwards at once. A string of weight two or more occurs elsewhere as a whole; its place is its own."""
        length, place = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
        strings = np.flatnonzero(self.sizes > 0)
        rows, at = strings.copy(), self.ends[strings] - 1
        above, below = self.above_ends[strings], self.below_ends[strings]
        up, down = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
        while len(rows):
            run = np.searchsorted(self.run_start, rows, "right") - 1
            head, tail = rows == self.run_start[run], rows == self.run_end[run]
            above, up = np.where(head, self.head_place[run], above - 1), np.where(head, self.head_length[run], up + 1)
            below, down = np.where(tail, self.tail_place[run], below - 1), np.where(tail, self.tail_length[run], down + 1)
            rows = self.lf[run] + rows - self.run_start[run]
            at = at - 1
            length[at], place[at] = np.maximum(up, down), np.where(up >= down, above, below)
            go = at > self.starts[strings]
            if not go.all():
                rows, at, above, below, up, down, strings = (x[go] for x in (rows, at, above, below, up, down, strings))
        for k in np.flatnonzero(self.weights > 1):
            b, e = self.starts[k], self.ends[k]
            length[b:e], place[b:e] = np.arange(e - b - 1, -1, -1), np.arange(b, e)
        return length, place

    def matches(self, length: int) -> list[np.ndarray]:
        """For each string the starts of its substrings of that length that occur with a weight of two or more."""
        where = np.flatnonzero(self.statistics()[0] >= length)
        cuts = np.searchsorted(where, np.append(self.starts, self.n))
        return [where[b:e] - s for b, e, s in zip(cuts[:-1], cuts[1:], self.starts, strict=True)]


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Merged intervals of the strings that start there."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + LENGTH).tolist(), strict=True))


def _halves(key: int, at: int, off: int, text: bytes, low: int, high: int) -> Iterator[tuple[int, int, int, bytes, int, int]]:
    """The context cut by the anchor's offset in its strings, low to high for all contexts of the key. Each half has a key that also holds
    the bytes which all strings of those offsets share."""
    middle, last = (low + high) // 2, len(text) - LENGTH  # this context has strings with the offsets off - last to off
    for least, most in ((low, middle), (middle + 1, high)):
        b, e = off - min(most, off), off - max(least, off - last)
        if b <= e:
            new = xxhash.xxh3_64_intdigest(text[off - least : off + LENGTH - most], seed=(key ^ most) & 0xFFFFFFFFFFFFFFFF)
            yield _signed(new), at + b, off - b, text[b : e + LENGTH], least, most


def settle(contexts: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """From key, row, at, off, text, weight, low, high: intervals row, at, size that are repeated (kind 0), and contexts to be settled again (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        pending: list[list[tuple]] = []
        size = pend = 0
        splitting = False
        current = None
        marks: list[tuple] = []
        schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("off", pa.int32()), ("size", pa.int32()), ("text", pa.binary()), ("weight", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def split(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            yield from out([(1, k, row, a, o, len(t), t, w, least, most) for key, row, at, off, text, w, low, high in rows for k, a, o, t, least, most in _halves(key, at, off, text, low, high)])

        def index(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            entries = [item for rows in groups for item in rows]
            if not entries:
                return
            found = RunIndex([e[4] for e in entries], [e[5] for e in entries]).matches(LENGTH)
            yield from out([(0, 0, row, at + b, 0, e - b, None, 0, 0, 0) for (_, row, at, *_), starts in zip(entries, found, strict=True) for b, e in _spans(starts)])

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if item[0] != current:
                    if splitting:
                        yield from split(group)
                    elif len(group) > 1 or group and group[0][5] > 1:
                        pending.append(group)
                        pend += size
                    if pend > INDEX_BYTES:
                        yield from index(pending)
                        pending, pend = [], 0
                    group, size, splitting, current = [], 0, False, item[0]
                if group and group[-1][4] == item[4]:  # equal contexts are one entry, and repeated as a whole
                    for _, row, at, _, text, _, _, _ in (group[-1], item) if group[-1][5] < 2 else (item,):
                        marks.append((0, 0, row, at, 0, len(text), None, 0, 0, 0))
                    group[-1] = (*group[-1][:5], 2, *group[-1][6:])
                    if len(marks) >= 10_000:
                        yield from out(marks)
                        marks = []
                    continue
                group.append(item)
                size += len(item[4])
                if size > group_bytes and len(item[4]) > LENGTH:
                    splitting = True
                if splitting and size > group_bytes:
                    yield from split(group)
                    group, size = [], 0
        if splitting:
            yield from split(group)
        elif group:
            pending.append(group)
        yield from out(marks)
        yield from index(pending)

    sorted_rows = contexts.select("key", "row", "at", "off", "text", "weight", "low", "high").repartition(parts(contexts.sparkSession), "key").sortWithinPartitions("key", "text")
    return sorted_rows.mapInArrow(run, "kind int, key bigint, row bigint, at bigint, off int, size int, text binary, weight int, low int, high int")


# -- documents -----------------------------------------------------------------------------------------------------------


def bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, _id, _bytes of all rows in a table bucketed by _row in the shared folder."""
    spark = docs.sparkSession
    path = work_folder(spark)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).cast("binary").alias("_bytes"))
    n = parts(spark)
    rows.repartition(n, "_row").write.bucketBy(n, "_row").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def marked(table: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """row, at, size of intervals that are repeated, of the rows of bucketed()."""
    spark = table.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    found = spool(sorted_out(anchor_rows(table.select("_row", "_bytes"))))
    marks = [found.where("kind = 0").select("row", "at", "size")]
    mixed = found.where("kind > 0")
    asked = mixed.join(mixed.where("kind = 1").select("key").distinct(), "key", "left_semi").select("key", "row", "at", "off", "size", F.col("kind").alias("weight"))
    contexts = asked.join(table, asked["row"] == table["_row"]).select("key", "row", "at", "off", F.expr("substring(_bytes, int(at) + 1, size)").alias("text"), "weight", F.lit(0).alias("low"), F.lit(LENGTH - GRAM).alias("high"))
    while True:
        settled = spool(settle(contexts, group_bytes))
        marks.append(settled.where("kind = 0").select("row", "at", "size"))
        contexts = settled.where("kind = 1")
        if contexts.isEmpty():
            break
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spans = repeated_spans(docs, id_col, text_col, group_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pieces, at = [], 0
                for s in own:
                    pieces.append(data[at : s["start"]])
                    at = s["end"]
                pieces.append(data[at:])
                out.append((len(data), sum(s["end"] - s["start"] for s in own), len(own), hashlib.sha256(b"".join(pieces)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans.select("_id", "_bytes", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """_row, _id, _bytes of every document, and spans: its maximal repeated byte runs as an array of (start, end)."""
    text_batches(docs.sparkSession)
    table = bucketed(docs, id_col, text_col)
    marks = marked(table, group_bytes)
    text_batches(docs.sparkSession)
    lists = marks.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))).alias("marks"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for own in batch.column(3).to_pylist():
                out: list[dict] = []
                for s in own or ():
                    if out and s["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], s["end"])
                    else:
                        out.append(dict(s))
                merged.append(out)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["_row", "_id", "_bytes", "spans"])

    rows = table.join(lists, table["_row"] == lists["row"], "left").select("_row", "_id", "_bytes", "marks")
    return rows.mapInArrow(merge, "_row bigint, _id bigint, _bytes binary, spans array<struct<start:bigint,end:bigint>>")
