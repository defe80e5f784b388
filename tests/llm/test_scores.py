"""Quality rules, toxicity, mixing and the pipeline."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, SF_SMALL, as_given, awkward, words
from weirstone.llm import kneser_ney as kn
from weirstone.llm import nearest_toxic as nt
from weirstone.llm import queries, soft_mixing


def slow_base(text):
    import re

    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
    inside = {j for k in range(len(own) - 4) if windows[tuple(own[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_base_counts():
    rng = random.Random(1)
    texts = [r[1] or "" for r in awkward()] + [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(200)]
    assert all(kn.base_counts(t) == slow_base(t) for t in texts)
    assert kn.base_failed(9, 0) and not kn.base_failed(10, 2) and kn.base_failed(10, 3)


class SlowKneserNey:
    """Dictionaries of byte strings: modified Kneser-Ney written out."""

    def __init__(self, rows):
        top = Counter()
        for lang, text in rows:
            data = b" " * (kn.ORDER - 1) + text
            top.update((lang, data[k : k + kn.ORDER]) for k in range(len(text)))
        self.levels = [dict(top)]
        for _ in range(kn.ORDER - 1):
            below = Counter()
            for lang, g in self.levels[0]:
                below[lang, g[1:]] += 1
            self.levels.insert(0, dict(below))
        self.discounts, self.contexts = [], []
        for level in self.levels:
            own = {}
            for lang in {x for x, _ in level}:
                n = [sum(c == k for (x, _), c in level.items() if x == lang) for k in (1, 2, 3, 4)]
                y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0
                own[lang] = [0.0] + [min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3)]
            self.discounts.append(own)
            c: dict = {}
            for (lang, g), v in level.items():
                c.setdefault((lang, g[:-1]), []).append(v)
            self.contexts.append(c)

    def p(self, lang, g):
        order = len(g)
        if not order:
            return 1 / 256
        d, seen = self.discounts[order - 1].get(lang), self.contexts[order - 1].get((lang, g[:-1]))
        if seen is None:
            return self.p(lang, g[1:])
        total = sum(seen)
        gamma = max(sum(d[min(v, 3)] for v in seen), 1e-9 * total) / total
        own = self.levels[order - 1].get((lang, g), 0)
        return (own - d[min(own, 3)]) / total + gamma * self.p(lang, g[1:]) if own else gamma * self.p(lang, g[1:])

    def bits(self, lang, text):
        data = b" " * (kn.ORDER - 1) + text
        return sum(-math.log2(self.p(lang, data[k : k + kn.ORDER])) for k in range(len(text))) / len(text)


def test_kneser_ney_equals_the_slow_way(spark, docs):
    rows = [(r[2], (r[1] or "").encode()) for r in awkward() if not kn.base_failed(kn.base_counts(r[1] or "")[0], kn.base_counts(r[1] or "")[4])]
    slow, model = SlowKneserNey(rows), kn.fit(docs)
    for lang, text in [*rows[:6], ("en", b"never seen before QQQ"), ("xx", b"no such language")]:
        data = np.frombuffer(text, np.uint8)
        got = model.score(data, np.array([0, len(data)]), np.array([kn.lang_number(lang)], np.uint64))[0]
        assert got == pytest.approx(slow.bits(lang, text), rel=1e-5)
    for hashes, values in (x for own in model.by_lang.values() for x in (*own.grams, *own.contexts)):
        assert (np.diff(hashes.astype(np.int64)) > 0).all() and len(hashes) == len(values) and len(hashes) <= 1 << kn.HASH_BITS
    total = sum(slow.p("en", b"ab c" + bytes([k])) for k in range(256))
    assert total == pytest.approx(1.0, abs=1e-6)


def test_model_is_exact_and_grows_with_the_corpus(spark):
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(rng.integers(33, 127, 7, np.uint8).tobytes().decode() for _ in range(60))) for _ in range(60)]
    docs = spark.createDataFrame([(k, t, lang, "s", 0) for k, (lang, t) in enumerate(rows)], SCHEMA)
    slow, model = SlowKneserNey([(lang, t.encode()) for lang, t in rows]), kn.fit(docs)
    assert [len(g[0]) for g in model.by_lang[kn.lang_number("en")].grams] == [len(x) for x in slow.levels]
    for text in (rows[0][1].encode(), b"never seen before QQQ"):
        got = model.score(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([kn.lang_number("en")], np.uint64))[0]
        assert got == pytest.approx(slow.bits("en", text), rel=1e-5)


def test_quality_query(docs, nothing, crowded):
    out = {(r.doc_id, r.n_words): r for r in kn.judge(docs).collect()}
    for key, text, *_ in awkward():
        base = slow_base(text or "")
        r = out[key, base[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == kn.base_failed(base[0], base[4]) and not (r.kept and r.base_failed)
    assert kn.judge(nothing).collect() == [] and kn.filtered(nothing).collect() == []
    kept = kn.filtered(crowded)
    assert as_given(kept, crowded.columns) and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3}


def test_noise_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(9)
    good = [(k, words(rng, 60, "etaoin"), "en", "s", 0) for k in range(150)]
    bad = [(1000 + k, "".join(chr(rng.randrange(33, 127)) for _ in range(400)).replace("", " ").strip(), "en", "s", 0) for k in range(2)]
    out = {r.doc_id: r.kept for r in kn.judge(spark.createDataFrame(good + bad, SCHEMA)).collect()}
    assert all(out[k] for k in range(150)) and not out[1000] and not out[1001]


def test_bands_reject_long_texts_that_are_a_little_odd(spark):
    rng = random.Random(21)
    good = [(k, words(rng, rng.randrange(12, 500), "etaoin"), "en", "s", 0) for k in range(300)]
    bad = [(1000 + k, " ".join(w + rng.choice(["***", " |", "###"]) if j % 3 == 0 else w for j, w in enumerate(words(rng, 400, "etaoin").split())), "en", "s", 0) for k in range(6)]
    copies = [(2000 + k, good[0][1], "en", "s", 0) for k in range(700)]
    out = {r.doc_id: r for r in kn.judge(spark.createDataFrame(good + bad + copies, SCHEMA)).collect()}
    assert not any(out[1000 + k].kept or out[1000 + k].base_failed for k in range(6))
    assert sum(out[k].kept for k in range(300)) >= 295 and all(r.low < r.high for r in out.values())


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        ids = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        w = rng.random(len(ids))
        vectors.append((ids, w / np.sqrt((w**2).sum())))
    index = nt.BlockMaxIndex(vectors, 50)
    dense = np.zeros((700, 50))
    for k, (ids, w) in enumerate(vectors):
        dense[k, ids] = w
    for k, (ids, w) in enumerate(vectors[:200]):
        got = index.nearest(ids, w, 10, without=k)
        cosines = dense @ dense[k]
        cosines[k] = -1
        want = sorted(((-c, j) for j, c in enumerate(cosines) if c > 0))[:10]
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want])
    assert nt.BlockMaxIndex([], 3).nearest(np.array([1]), np.array([1.0]), 5) == []


def toxic_rows(n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        bad, text = k % 6 == 0, words(rng, 60).split()
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(["idiotic", "wretch", "vermin"]) if k % 12 else "vile" + "".join(rng.choice("xyz") for _ in range(4)))
        rows.append((k, " ".join(text), "en", "s", 0))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity(spark, docs, nothing):
    rows, labels = toxic_rows()
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = nt.score(df, nt.fit(df, lab)).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and len(r.evidence_ids) <= 3 for r in out)
    brier = sum((r.score - (r.doc_id % 6 == 0)) ** 2 for r in held) / len(held)
    assert brier < 0.05
    model = nt.fit(docs, lab.limit(0))
    bare = nt.score(docs, model).collect()
    assert len(bare) == len(awkward()) and {r.score for r in bare} == {0.5}
    assert nt.score(nothing, nt.fit(nothing, lab)).collect() == []


def test_held_out_labels_change_nothing(spark):
    rows, labels = toxic_rows(300)
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, q, t in labels]
    df = spark.createDataFrame(rows, SCHEMA)
    scores = [sorted((r.doc_id, r.score) for r in nt.score(df, nt.fit(df, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int"))).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_rates_solve_the_problem(spark):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 400, 300)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "_tokens bigint, _p array<double>")
    def rates(fit):
        got = df.select("_tokens", "_p", fit.rate.alias("r")).collect()
        sums = np.array([[x.r * x["_tokens"] * q for q in x["_p"]] for x in got]).sum(axis=0)
        assert sums == pytest.approx(fit.reached, rel=1e-6) and fit.converged
        return np.array([x.r for x in got]), sums

    # whatever can be met is met
    for targets, budget in (([0.6, 0.3, 0.1], 1.0), ([0.05, 0.9, 0.05], 3.0), ([0.34, 0.33, 0.33], 0.4)):
        fit = soft_mixing.fit_rates(df, targets, budget=budget)
        r, sums = rates(fit)
        assert (r >= 0).all() and sums / n.sum() == pytest.approx(np.array(targets) * budget, abs=1e-6) and fit.told(["a", "b", "c"])
        assert fit.aimed == pytest.approx(np.array(targets) * budget * n.sum())
    # what can't be is missed by no more than the least squares solution, here by very many plain steps
    for least, most, targets in ((0.0, 1.5, [0.9, 0.05, 0.05]), (1.0, 2.0, [0.1, 0.2, 0.9]), (0.0, math.inf, [1.0, 0.0, 0.0])):
        fit = soft_mixing.fit_rates(df, targets, least, most)
        r, sums = rates(fit)
        aim, a = np.array(targets) * n.sum(), p * n[:, None]
        slow, size = np.ones(300), 1 / np.linalg.eigvalsh(a.T @ p)[-1]
        for _ in range(20_000):
            slow = np.clip(slow - size * (p @ (slow @ a - aim)), least, most)
        best = ((slow @ a - aim) ** 2).sum()
        assert best > 1 and fit.told(["a", "b", "c"]) == (most == math.inf) and (r >= least).all() and (r <= most).all()
        assert ((sums - aim) ** 2).sum() <= best * (1 + 1e-5)


def test_calibration():
    rng = np.random.default_rng(3)
    logs = rng.normal(size=(4000, 3)) * 2
    p = np.exp(0.5 * logs + [0.5, 0.0, -0.5])
    truth = np.array([rng.choice(3, p=x / x.sum()) for x in p])
    own = soft_mixing.Classifier(["a", "b", "c"], [], [], {})
    own.calibrate(logs, truth)
    assert own.heat == pytest.approx(0.5, abs=0.05) and own.shift[0] - own.shift[2] == pytest.approx(1.0, abs=0.15)
    own.calibrate(logs[:0], truth[:0])


def mixing_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        kind = k % 4
        text = {0: lambda: words(rng, 40), 1: lambda: words(rng, 40) + " wretch vermin", 2: lambda: " ".join(w + "***" for w in words(rng, 40).split()), 3: lambda: " ".join(w + "%%%" for w in words(rng, 30).split()) + " wretch vermin"}[kind]()
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        if k % 2 == 0 or kind % 2:
            labels.append((k, int(kind < 2), kind % 2))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_mixing(spark, docs, nothing, crowded):
    df, labels = mixing_rows(spark)
    out = soft_mixing.rated(df, labels)
    rows = out.collect()
    right = {0: "q1t0", 1: "q1t1", 2: "q0t0", 3: "q0t1"}
    assert sum(r.domain == right[r.doc_id % 4] for r in rows) / len(rows) > 0.95
    names = [f"p_{d}" for d in soft_mixing.TARGETS]
    assert all(sum(r[c] for c in names) == pytest.approx(1.0) and r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    share = [sum(r.rate * r.n_tokens * r[c] for r in rows) / total for c in names]
    assert share == pytest.approx(list(soft_mixing.TARGETS.values()), abs=1e-6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert soft_mixing.rated(docs, labels).count() == len(awkward())
    assert soft_mixing.rated(docs, labels.limit(0)).count() == len(awkward())
    assert soft_mixing.rated(nothing, labels).collect() == []
    mixed = soft_mixing.mixed(crowded, labels)
    assert as_given(mixed, crowded.columns)
    assert {r.doc_id for r in mixed.collect()} <= {r[0] for r in awkward()}
    assert {r.doc_id for r in soft_mixing.mixed(crowded, labels, least=1.0).collect()} == {r[0] for r in awkward()}


def test_mixing_repeats_what_is_wanted(spark):
    df, labels = mixing_rows(spark)
    counts = Counter(r.doc_id for r in soft_mixing.mixed(df, labels, {"q1t0": 0.7, "q1t1": 0.1, "q0t0": 0.1, "q0t1": 0.1}, budget=1.5).collect())
    assert set(range(0, 400, 4)) < set(counts) < set(range(400))  # what is wanted stays whole, of the rest a part
    mean = lambda kind: np.mean([counts[k] for k in range(400) if k % 4 == kind])
    assert mean(0) > 2 and mean(2) < 1.2


def test_mixing_has_no_upper_rate_and_tells_of_misses(spark, caplog):
    df, labels = mixing_rows(spark)
    targets = {"q1t0": 0.8, "q1t1": 0.1, "q0t0": 0.05, "q0t1": 0.05}
    counts = Counter(r.doc_id for r in soft_mixing.mixed(df, labels, targets, budget=2.0, least=1.0).collect())
    assert np.mean([counts[k] for k in range(0, 400, 4)]) > 5
    assert "targets missed" in caplog.text  # two domains have a quarter of the tokens and should have a tenth
    assert max(r.rate for r in soft_mixing.rated(df, labels, {"q1t0": 0.01, "q1t1": 0.01, "q0t0": 0.01, "q0t1": 9.0}).collect()) > 8


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")
def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    from weirstone.llm.shared import spool

    outs = []
    for _, stage in corpus_pipeline.STAGES:
        out = spool(stage(spark, docs, SF_SMALL))
        outs.append(out)
        docs = out
    columns = spark.read.parquet(f"{SF_SMALL}/documents.parquet").columns
    assert all(o.columns == columns for o in outs[:-1])
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in outs]
    assert ids[0] == ids[1] >= ids[2] >= ids[3] == ids[4]
    assert outs[2].count() == len(ids[2])
    final = sorted(map(tuple, outs[-1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == final


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_registered_queries_cover_their_table(spark, name):
    out = queries.QUERIES[name](spark, SF_SMALL)
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert out.columns[0] == "doc_id" and out.select(F.countDistinct("doc_id")).first()[0] == out.count()
