"""SimHash, repeated lines, windows and byte strings against brute force."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from tests.llm.conftest import SCHEMA, as_given, awkward, by_id, words
from weirstone.llm import ball_simhash, line_windows, near_copies, run_index, unit_hashes


def slow_fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(own[k : k + 3]) for k in range(len(own) - 2)] if len(own) >= 3 else [" ".join(own)] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(items, near):
    root = {k: k for k in range(len(items))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(items))]


def test_fingerprints():
    for text in ["", "one", "one two", "A b c d", "a b c a b c a b c", *(words(random.Random(k), 40) for k in range(20))]:
        assert ball_simhash.fingerprint(text) == slow_fingerprint(text)


def test_simhash_query(docs, nothing, crowded):
    rows = sorted(awkward(), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [slow_fingerprint(r[1] or "") for r in rows]
    roots = slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = [(r[0], f"{p:016x}", rows[k][0]) for r, p, k in zip(rows, prints, roots, strict=True)]
    assert by_id(ball_simhash.near_duplicates(docs).collect()) == by_id(want)
    assert by_id(ball_simhash.near_duplicates(crowded).collect()) == by_id(want)
    assert ball_simhash.near_duplicates(nothing).collect() == []
    kept = ball_simhash.keep_one(crowded)
    assert as_given(kept, crowded.columns)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted({w[2] for w in want if w[2] is not None})


def test_near_copies_equal_brute_force(spark, nothing, crowded):
    import corpus_pipeline

    def slow_set(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {" ".join(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()

    rng = random.Random(17)
    rows = []
    for k in range(60):
        base = words(rng, rng.randrange(60, 200)).split()
        rows.append(" ".join(base))
        for _ in range(4):  # changes in one stretch or a few places: similarities on both sides of 0.8
            own = list(base)
            for _ in range(rng.randrange(1, 4)):
                at, n = rng.randrange(len(own)), rng.randrange(1, 8)
                own[at : at + n] = words(rng, n).split()
            rows.append(" ".join(own))
    rows += ["", " ", "one two", "One  two", "one two three"]
    rows = list(dict.fromkeys(rows))
    sets = [slow_set(t) for t in rows]
    roots = slow_components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert len(set(roots)) < len(rows) - 50
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(rows)], SCHEMA).repartition(4)
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(roots))
    assert near_copies.keep_one(nothing).collect() == []
    assert as_given(near_copies.keep_one(crowded), crowded.columns)


def test_near_copies_meet_by_simhash(spark):
    """Fingerprints, keys and the groups that links of fingerprints make within a key, against brute force."""
    rng = random.Random(23)
    texts = ["", "one two", words(rng, 700)]
    for _ in range(40):
        own = words(rng, rng.randrange(40, 120)).split()
        for n in (0, 1, 1, 2, 6):
            near = list(own)
            for _ in range(n):
                near[rng.randrange(len(near))] = words(rng, 1)
            texts.append(" ".join(near))
    texts = list(dict.fromkeys(texts))
    bits, number = near_copies.tables(60_000)
    width = -(-bits * number // 64)
    rows = spark.createDataFrame(list(enumerate(texts)), "_row bigint, text string").repartition(3)
    sketched = near_copies.sketches(rows, width)
    prints = {r._row: r.print for r in sketched.collect()}
    full = (1 << 64) - 1

    def slow_print(hashes):
        out = b""
        for word in range(1, width + 1):
            ones = [0] * 64
            for h in hashes:
                h = h + word * 0x9E3779B97F4A7C15 & full
                h = (h ^ h >> 30) * 0x94D049BB133111EB & full
                h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & full
                h ^= h >> 29
                for bit in range(64):
                    ones[bit] += h >> bit & 1
            out += bytes(sum((2 * ones[8 * lane + bit] > len(hashes)) << 7 - bit for bit in range(8)) for lane in range(8))
        return out

    assert prints[0] is None
    for k in (1, 2, 3, 9):
        assert prints[k] == slow_print(near_copies.shingles(texts[k]).tolist())
    strings = {k: "".join(f"{byte:08b}" for byte in p) for k, p in prints.items() if p is not None}
    first = {k: (int(t[:64], 2), int(t[64:128], 2)) for k, t in strings.items()}

    def near(a, b):
        one, two = ((x ^ y).bit_count() for x, y in zip(first[a], first[b], strict=True))
        return one <= 24 and one + two <= 38

    want = set()
    for table in range(number):
        met: dict[str, list] = {}
        for k, bits_of in strings.items():
            met.setdefault(bits_of[bits * table : bits * (table + 1)], []).append(k)
        for group in met.values():
            roots = slow_components(group, near)
            want |= {frozenset(x for x, r in zip(group, roots, strict=True) if r == root) for root in roots if roots.count(root) > 1}
    found: dict[int, set] = {}
    for r in near_copies.candidates(sketched.withColumnRenamed("_row", "node"), bits, number).collect():
        found.setdefault(r.bucket, set()).add(r.node)
    assert {frozenset(g) for g in found.values()} == want and len(want) > 60


def test_simhash_finds_near_copies():
    """Pairs at a similarity of 0.8 just about have a key in common; large groups are told apart like small ones."""
    rng = np.random.default_rng(4)
    bits, number = near_copies.tables(1_000_000)
    missed = 0
    for k in range(400):
        common, extra = (k % 40 + 1) * 8, k % 40 + 1
        pool = rng.integers(0, 1 << 63, common + 2 * extra).astype(np.uint64)
        sets = [np.sort(pool[: common + extra]), np.sort(np.concatenate((pool[:common], pool[common + extra :])))]
        prints = near_copies.fingerprints(sets, -(-bits * number // 64))
        first = prints[:, :16].copy().view(np.uint64)
        one, other = near_copies.keys(prints, bits, number)
        missed += not (one == other).any() or not len(near_copies.near(first[:1], first[1:])[0])
    assert missed <= 2
    centres = rng.integers(0, 1 << 63, (3_000, 2)).astype(np.uint64)
    members = np.concatenate((centres, centres[:200] ^ np.uint64(5), np.repeat(centres[7:8], 600, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (600, 1)).astype(np.uint64))))
    bits_apart = np.bitwise_count(members[:, None] ^ members[None])
    near = [np.flatnonzero(row).tolist() for row in (bits_apart.sum(axis=2) <= 38) & (bits_apart[:, :, 0] <= 24)]
    want, seen = [], set()
    for k in range(len(members)):
        if k in seen:
            continue
        front, own = [k], {k}
        while front:
            reached = set(near[front.pop()]) - own
            own |= reached
            front.extend(reached)
        if len(own) > 1:
            want.append(sorted(own))
        seen |= own
    assert sorted(g.tolist() for g in near_copies.linked(members)) == want and len(want) > 150 and max(map(len, want)) > 600


def test_links_in_all_places(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:80]:
        for _ in range(rng.randrange(1, 8)):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                p ^= 1 << bit
            prints.add(p)
    hub = next(iter(prints))
    for _ in range(600):  # one dense group
        p = hub
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    links = ball_simhash.links(df)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in links.collect())
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in ball_simhash.components(links).collect()}
    groups: dict[int, set] = {}
    for p in prints:
        groups.setdefault(found.get(p, p), set()).add(p)
    want: dict[int, set] = {}
    for p, k in zip(prints, slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 3), strict=True):
        want.setdefault(k, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in ball_simhash.components(edges).collect()}
    assert all(got[k] == 0 for k in range(301)) and got[1001] == 1000
    assert ball_simhash.components(edges.where("a < 0")).collect() == []


def in_duckdb(rows, sql):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return con.sql(sql).fetchall()


@pytest.mark.parametrize("module", [line_windows, unit_hashes])
def test_repeats_equal_sql(spark, docs, nothing, module):
    seen, rows = set(), []
    for r in awkward():  # SQL tells rows apart by their ids only
        if r[0] is not None and r[0] not in seen and r[0] != 108:
            rows.append(r)
            seen.add(r[0])
    got = module.digests(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", *(["n_lines", "n_removed"] if module is line_windows else ["n_units", "n_removed", "removed_chars", "removed_spans"]), "kept_sha256")
    names = got.columns
    con_rows = in_duckdb(rows, f"SELECT {', '.join(names)} FROM ({module.ORACLE})")
    assert by_id(got.collect()) == by_id(con_rows)
    assert module.digests(docs).count() == len(awkward())
    assert module.digests(nothing).collect() == []


def test_line_windows_literal(spark, crowded):
    three = "a b\nc d\ne f"
    rows = [(1, f"x\n{three}\ny"), (2, f"{three}\n\nz"), (3, "q\n" * 6), (4, f"g\n{three}\n{three}"), (None, three)]
    got = {r.doc_id: r.text for r in line_windows.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: f"x\n{three}\ny", 2: "\nz", 3: "q\nq\nq\n", 4: "g", None: ""}
    out = line_windows.deduplicated(crowded)
    assert as_given(out, crowded.columns) and out.count() == len(awkward())
    assert out.where("doc_id = 100").first().text is None


def test_units_literal(spark, crowded):
    long = "These  five words make one unit"
    rows = [(2, f"{long.upper()}\nshort\nend"), (1, f"short\n{long}\nshort")]
    out = {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in unit_hashes.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), "line", 5, 5).collect()}
    assert out == {1: (rows[1][1], []), 2: ("short\nend", [(0, len(long) + 1)])}
    paragraphs = spark.createDataFrame([(1, "a b c d e\nf\n\n\nx"), (2, "y\n\na b c d e\nf")], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in unit_hashes.deduplicated(paragraphs, "paragraph", 5, 5).collect()} == {1: "a b c d e\nf\n\n\nx", 2: "y\n\n"}
    assert as_given(unit_hashes.deduplicated(crowded), [*(c for c in crowded.columns if c != "removed"), "removed"])


def test_passages_within_lines(spark):
    """A passage of sentences goes wherever it lies in a line, a common sentence of its own stays."""
    rng = random.Random(9)
    sentence = lambda n: words(rng, n).capitalize() + rng.choice([".", "!", "?"])
    passage = [sentence(9) for _ in range(4)]
    common = sentence(12)
    one = f"{sentence(8)} and so {' '.join(passage)}"
    two = f"{common} Then {' '.join(passage)} {sentence(7)}\n{common}"
    unspaced = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, one), (2, two), (3, f"{common} x"), (4, unspaced), (5, f"y\n{unspaced}\nz"), (6, " ".join(passage[1:3]))]
    got = {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in unit_hashes.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    inner = " ".join(passage[1:]) + " "  # its first sentence is joined to what stands before it
    at = two.index(inner)
    assert got[2] == (two.replace(inner, ""), [(at, at + len(inner))])
    assert got[5] == ("y\nz", [(2, 303)])
    assert all(got[k] == (text, []) for k, text in rows if k not in (2, 5))


def test_passages_equal_sql(spark):
    rng = random.Random(10)
    pool = [words(rng, rng.randrange(1, 14)) + rng.choice([".", "!  ", "?", ". ", "", "。", " .\t"]) for _ in range(60)]
    rows = [(k, "".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "", "\n\n"]) for _ in range(rng.randrange(0, 40))), "en", "s", 0) for k in range(150)]
    got = unit_hashes.digests(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert by_id(got.collect()) == by_id(in_duckdb(rows, f"SELECT {', '.join(got.columns)} FROM ({unit_hashes.ORACLE})"))
    assert sum(r.n_removed for r in got.collect()) > 50


def slow_repeats(rows, length=200):
    counts: Counter = Counter()
    for _, b in rows:
        counts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for key, b in rows:
        marks = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                marks[k] += 1
                marks[k + length] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_run_index():
    rng = random.Random(5)
    for _ in range(250):
        length, alphabet = rng.choice([3, 5, 8, 15, 20]), rng.choice([b"ab", b"abc", bytes(range(6)), b"a", b"\0\xff"])
        strings = list({bytes(rng.choice(alphabet) for _ in range(rng.randrange(length, 60))) for _ in range(rng.randrange(1, 9))})
        weights = [rng.choice([1, 1, 2]) for _ in strings]
        counts: Counter = Counter()
        for s, w in zip(strings, weights, strict=True):
            for k in range(len(s) - length + 1):
                counts[s[k : k + length]] += w
        index = run_index.RunIndex(strings, weights)
        assert [m.tolist() for m in index.matches(length)] == [[k for k in range(len(s) - length + 1) if counts[s[k : k + length]] > 1] for s in strings]


def test_matching_statistics():
    """Lengths and places against brute force; in a repetitive collection there are few runs, so few samples."""
    rng = random.Random(9)
    for _ in range(200):
        alphabet = rng.choice([b"ab", b"abc", b"a", b"\0\xff", bytes(range(7))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 7))]
        weights = [rng.choice([1, 1, 1, 2]) for _ in strings]
        index = run_index.RunIndex(strings, weights)
        length, place = index.statistics()
        where = [(k, at) for k, s in enumerate(strings) for at in range(len(s))]
        for k, at in where:
            own = strings[k][at:]
            best = len(own) if weights[k] > 1 else max((len(os.path.commonprefix([own, strings[j][x:]])) for j, x in where if (j, x) != (k, at)), default=0)
            n, x = int(length[index.starts[k] + at]), int(place[index.starts[k] + at])
            assert n == best
            if n:
                j = int(np.searchsorted(index.starts, x, "right")) - 1
                assert strings[j][x - index.starts[j] :][:n] == own[:n] and (weights[k] > 1 or (j, x - index.starts[j]) != (k, at))
    text = bytes(rng.randrange(97, 123) for _ in range(400))
    copies = run_index.RunIndex([text[k:] for k in range(60)], [1] * 60)
    assert len(copies.run_start) == len(copies.head_length) == len(copies.tail_length) < 0.05 * copies.n


def test_anchors_are_the_strings_own():
    rng = random.Random(6)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(900))
    one, two = b"x" * 300 + text, text + b"y" * 250
    found = {}
    for name, data in (("one", one), ("two", two)):
        key, place, first, last = run_index.anchors(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        found[name] = {s: (k, p - s) for k, p, b, e in zip(key.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(b, e + 1)}
    assert all(found["one"][300 + s] == found["two"][s] for s in range(701))


def test_long_documents_are_cut():
    """Every string of 200 bytes lies in just one piece, from its start to its end."""
    offsets = np.array([0, 50, 4000, 4100, 4100, 9000])
    seen = Counter()
    for first, last, begin, end in run_index.blocks(offsets, 700):
        assert end - begin <= 1400 and offsets[first] <= begin and end <= offsets[last]
        cuts = offsets[first : last + 1] if last - first > 1 else [begin, end]
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            seen.update(range(int(b), int(e) - 199))
    assert seen == Counter({s: 1 for b, e in zip(offsets[:-1], offsets[1:], strict=True) for s in range(int(b), int(e) - 199)})


def test_repeats_in_long_documents(spark):
    rng = random.Random(12)
    long = words(rng, 220_000)
    passage = words(rng, 80)
    cut = run_index.BLOCK_BYTES
    rows = [(1, long[: cut - 100] + passage + long[cut - 100 :]), (2, passage), (3, words(rng, 200))]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in run_index.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(long) > 2 * cut and got == {1: (len(passage), 1), 2: (len(passage), 1), 3: (0, 0)}


@pytest.mark.parametrize("group_bytes", [run_index.GROUP_BYTES, 1500])
def test_byte_repeats(spark, docs, nothing, group_bytes):
    rng = random.Random(2)
    parts = [words(rng, 60), words(rng, 45)]
    rows = [(k, words(rng, rng.randrange(60)) + rng.choice([*parts, parts[0][:250], parts[0][40:], ""]) + words(rng, rng.randrange(60))) for k in range(120)]
    rows += [(400, None), (401, ""), (402, "ab" * 1500), (403, "ab" * 150), (404, rows[3][1]), (404, rows[3][1]), (405, "x" * 199), (406, "y" * 200), (407, "z" * 201), (408, "é" * 300), (None, rows[5][1])]
    got = run_index.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), group_bytes=group_bytes).collect()
    assert by_id(got) == by_id(slow_repeats([(k, (t or "").encode()) for k, t in rows]))


def test_byte_repeats_of_awkward_rows(docs, nothing, crowded):
    want = by_id(slow_repeats([(r[0], (r[1] or "").encode()) for r in awkward()]))
    assert by_id(run_index.digests(docs).collect()) == want
    assert by_id(run_index.digests(crowded).collect()) == want
    assert run_index.digests(nothing).collect() == []
    spans = run_index.repeated_spans(docs.where("doc_id = 103")).collect()
    assert all([(s.start, s.end) for s in r.spans] == [(0, len(r["_bytes"]))] for r in spans if len(r["_bytes"]) >= 200)


def test_sorted_out_over_batches(spark):
    """Contexts of one anchor that span many batches are judged like any others."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    rng = random.Random(8)
    rows = [(rng.randrange(6), rng.randrange(4), k, 0, 0, 0, 1) for k in range(60)] + [(9, 1, 100, 0, 0, 0, 2), (10, 1, 101, 0, 0, 0, 3), (11, 1, 102, 0, 0, 0, 2), (11, 2, 103, 0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "key bigint, ctx bigint, row bigint, at bigint, off int, size int, weight int")
    got = run_index.sorted_out(df).collect()
    keys, both = Counter(r[0] for r in rows), Counter(r[:2] for r in rows)
    whole = {r[2] for r in rows if both[r[:2]] > 1 or r[6] > 1}
    once = {r[2] for r in rows if both[r[:2]] == 1 and keys[r[0]] > 1 and r[6] == 1}
    assert {r.row for r in got if r.kind == 0} == whole
    assert {r.row for r in got if r.kind == 1} == once
    ones = Counter((r.key, r.ctx) for r in got if r.kind == 2)
    distinct = {k: {c for kk, c in both if kk == k} for k, _ in both}
    assert ones == Counter(kc for kc, n in both.items() if (n > 1 or kc == (11, 1)) and len(distinct[kc[0]]) > 1)
