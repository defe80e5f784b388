"""SimHash near-duplicates by meeting in the middle of Hamming balls, around what is left of a fingerprint without one of four blocks.

Fingerprints within RADIUS = 3 bits link. Two fingerprints at distance 3 have no common variant within one flipped bit, and
all variants within two flips are 2,081 for each fingerprint. So the odd bit is taken out beforehand: the 64 bits are
four blocks of 16, and of the differing bits of a linked pair at least one lies in some block (or none differ). With that block
left out two differing bits remain at most, and half of that radius is one: for each of the four blocks every fingerprint emits
the 48 bits that are left and all variants of them with one bit flipped, 196 keys in all. A linked pair shares a
key; the pairs that share one are verified on all 64 bits.

Only distinct fingerprints emit, so a group of copies costs what one document costs. Rows with one key meet in one task in sorted
order, at most 49 * 2 ** 16 distinct fingerprints whatever the table holds (48 bits of theirs are the key's, but for a flip). A large group is compared block by block in numpy, and no pair leaves it that isn't needed for its
connection (a spanning forest), so what is emitted grows with the members and not with their pairs. Components come from
repeated large-star and small-star steps, each written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; null ids take part, and the component's id is the
smallest id that is not null; repeated rows are kept and link; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm.shared import parts, run_bounds, spool, text_batches, text_of, unpacked, whole_row

RADIUS = 3
SEED = 42
#: Fixed value: words are what stands between ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fixed value: only A to Z change.
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Shingle hashes that are counted bit by bit at once: 8 MB unpacked.
BLOCK_HASHES = 1 << 17
#: Members of a group compared with all others at once.
BLOCK_MEMBERS = 1_024
BLOCK_BITS, BLOCKS = 16, 4


def fingerprint(text: str, words_in_shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    if len(words) <= words_in_shingle:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*(words[k:] for k in range(words_in_shingle)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s.encode("utf-8", "surrogatepass"), SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK_HASHES):
        ones += np.unpackbits(hashes[at : at + BLOCK_HASHES], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a signed long) of every row."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text")).mapInArrow(run, "id bigint, fp bigint")


def _variants(fps: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, a row each: two bits for the block that is left out, then the other 48 bits."""
    out = []
    for block in range(BLOCKS):
        low = (np.uint64(1) << np.uint64(BLOCK_BITS * block)) - np.uint64(1)
        high = ~((low << np.uint64(BLOCK_BITS)) | np.uint64((1 << BLOCK_BITS) - 1))
        rest = (fps & low) | ((fps & high) >> np.uint64(BLOCK_BITS))
        rest |= np.uint64(block << 62)
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64 - BLOCK_BITS, dtype=np.uint64)))
        out.append(rest[:, None] ^ flips[None, :])
    return np.concatenate(out, axis=1)


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Verified links that hold a group's linked members together; members are distinct.

    Members are visited in blocks: who is reached from a block is taken off the rest, so each pair is compared once at most.
    """
    links, rest = [], members
    while len(rest) > 1:
        reached, rest = rest[:1], rest[1:]
        while len(reached) and len(rest):
            front, later = reached[:BLOCK_MEMBERS], [reached[BLOCK_MEMBERS:]]
            by = np.full(len(rest), -1)
            for at in range(0, len(rest), BLOCK_MEMBERS * 16):
                near = np.bitwise_count(front[:, None] ^ rest[None, at : at + BLOCK_MEMBERS * 16]) <= RADIUS
                by[at : at + BLOCK_MEMBERS * 16] = np.where(near.any(axis=0), near.argmax(axis=0), -1)
            links.extend(zip(front[by[by >= 0]].tolist(), rest[by >= 0].tolist(), strict=True))
            later.append(rest[by >= 0])
            reached, rest = np.concatenate(later), rest[by < 0]
    return links


def links(fps: DataFrame) -> DataFrame:
    """Distinct verified links a, b between distinct fingerprints (column fp), enough of them to connect all that link."""
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(own), 500):
                few = own[at : at + 500]
                keys = _variants(few)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(few, keys.shape[1]).view(np.int64))], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def match(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            bounds = run_bounds(keys)
            size = np.diff(bounds)
            first = bounds[:-1][size == 2]
            x, y = own[first].view(np.uint64), own[first + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= RADIUS
            pairs = [np.stack((x[near], y[near]))]
            for b, e in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
                pairs.append(np.array(_forest(np.unique(own[b:e].view(np.uint64))), np.uint64).reshape(-1, 2).T)
            x, y = np.concatenate(pairs, axis=1).view(np.int64)
            both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
            both = both[both[:, 0] != both[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in range(2)], schema=schema)

        for batch in batches:
            keys, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on in the next batch
            if held[0] and held[0][0][0] == keys[-1]:
                held[0].append(keys)
                held[1].append(own)
                continue
            yield match(np.concatenate([*held[0], keys[:cut]]), np.concatenate([*held[1], own[:cut]]))
            held = ([keys[cut:]], [own[cut:]])
        yield match(np.concatenate([none, *held[0]]), np.concatenate([none, *held[1]]))

    # a fingerprint makes 196 rows: dealt out beforehand, as few tasks would be enough for the fingerprints themselves. They come grouped by
    # fp: by that column itself the exchange would be taken for the grouping's own, and its partitions coalesced by their small size
    keyed = fps.select("fp").repartition(parts(spark), F.xxhash64("fp")).mapInArrow(emit, "key bigint, fp bigint")
    return keyed.repartition(parts(spark), "key").sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node that an edge a, b touches.

    Large-star then small-star until nothing changes; each round is written to the shared folder, the driver sees one sum a round.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = spool(small)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row."""
    rows = spool(fingerprints(docs, words_in_shingle, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(nodes))
    roots = nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but one row of each component: the one with the smallest id, of equal ids the first text.

    Rows whose id is null are components' members like others and stay only if their component has no id at all.
    """
    rows = spool(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("_row")))
    marks = near_duplicates(rows.select("_row", F.col("_doc").getField(text_col).alias("_body")), words_in_shingle, "_row", "_body")
    return firsts(rows, marks, id_col, text_col).select(*unpacked(docs))


def firsts(rows: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One of the rows (_doc, _row) of each component; marks has the row (doc_id) and component_id of each."""
    text = F.col("_doc").getField(text_col)
    ranked = marks.join(rows.select("_row", F.col("_doc").getField(id_col).cast("bigint").alias("_id"), F.xxhash64(text).alias("_text")), marks.doc_id == F.col("_row"))
    best = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_text", "_row")).alias("best")).select(F.col("best._row").alias("_row"))
    return rows.join(best, "_row", "left_semi")
