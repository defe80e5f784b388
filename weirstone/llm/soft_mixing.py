"""Mixing to target weights by soft membership: rates for documents whose expected domain tokens meet the targets.

The label table says which domain a labelled document belongs to (by default its quality and toxicity marks). A naive Bayes
classifier over shape bins and marker words, the MARKERS that tell the domains best apart of those whose likelihood ratio is no chance (other words have no say), fitted on a bounded sample of
labelled rows, gives every document a posterior over the domains. One heat and a shift for each domain are fitted on the labelled rows
of every fifth sketch, which the classifier doesn't see.
Posteriors are rounded to multiples of 1 / GRID. The rates r then solve, by projected gradient steps,

    minimise |A r - t|^2,  r within [least, most],   (A r)_d = sum over documents of tokens * p_d * r

where t are the targets' shares of a budget; of all solutions the one nearest to rates of 1 is aimed at, by a ridge e * |r - 1|^2 (weighted by tokens) that falls
to nothing step by step. Steps are projected lazily: a vector of as many numbers as there are domains adds up the gradients A r - t, preconditioned by the matrix sum(tokens * p * p')
of the documents within the bounds, and a rate is 1 less its posterior's product with that vector, put back into the bounds. So a rate is a function of its posterior
alone, documents of equal posteriors have equal rates, and all steps work on the token sums by posterior: a row for each point of the grid that occurs, whatever the
number of documents. A step that doesn't bring the dual objective down is halved. The fit ends when the targets are met to TOLERANCE of all tokens, or at the least ridge, with
the least squares solution of targets that can't be met.

All of it is DataFrame functions; the driver only solves systems of the size of the domain list.

Defined cases: a null or empty text has no tokens and the posterior of its bins; labels that are null or of no known domain and labels without
a document are left out; without any labels the posterior is even; rows with equal ids are rated one by one; an empty table
gives an empty result; other columns stay as they are in mixed().
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.llm.shared import spool, unpacked, whole_row

#: Domains and their shares of all tokens: quality (q) and toxicity (t) marks.
TARGETS = {"q1t0": 0.88, "q1t1": 0.04, "q0t0": 0.06, "q0t1": 0.02}
#: Bounds of the fit: labelled rows and marker words.
FIT_ROWS, MARKERS = 20_000, 128
#: A marker's log likelihood ratio is so many nats at least: of some ten thousand words that say nothing about one reaches it by chance.
LEAST_GAIN = 10.0
SMOOTHING = 2.0
#: Posteriors are multiples of 1 / GRID. Of CALIBRATE sketches one is left out of the classifier and calibrates it.
GRID, CALIBRATE = 256, 5
STEPS, TOLERANCE, RIDGE = 200, 1e-7, 1e-10
#: A mix whose domains are further off than this share of the tokens aimed at misses its targets, which is logged.
MET = 0.002
#: Upper ends of the shape features' bins.
BINS = {
    "words": [5, 10, 40, 160, 640, 2560],
    "distinct": [0.05, 0.2, 0.4, 0.6, 0.8],
    "symbols": [0.001, 0.01, 0.05, 0.1],
    "capitals": [0.01, 0.05, 0.1, 0.5],
    "length": [3.0, 4.5, 6.0, 8.0],
}
#: What stands between words, symbols and capitals.
BETWEEN, SYMBOLS, CAPITALS = r"[\s\p{Punct}]+", r"[#*$%&|<>]", r"\p{Lu}"


def label_domain() -> Column:
    """The domain of a row of labels."""
    return F.concat(F.lit("q"), F.col("quality").cast("int").cast("string"), F.lit("t"), F.col("toxic").cast("int").cast("string"))


def _bin(value: Column, ends: list[float]) -> Column:
    """Number of the bin, from 1."""
    out = F.lit(1)
    for e in ends:
        out = out + F.when(value > e, 1).otherwise(0)
    return out


def described(docs: DataFrame, text_col: str, sketched: bool = False) -> DataFrame:
    """The rows with _words (distinct, lower case), _tokens and _bins (one number for each shape feature); sketched: also _sketch,
    the least hash of two words in a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_all", F.filter(F.split(F.lower("_text"), BETWEEN), lambda w: w != "")).withColumn("_words", F.array_distinct("_all"))
    if sketched:
        pairs = F.zip_with("_all", F.slice("_all", F.lit(2), F.size("_all")), lambda a, b: F.hash(a, b))
        rows = rows.withColumn("_sketch", F.coalesce(F.array_min(pairs), F.hash("_text")))
    n, chars = F.size("_all"), F.greatest(F.length("_text"), F.lit(1))
    shape = {
        "words": n,
        "distinct": F.size("_words") / F.greatest(n, F.lit(1)),
        "symbols": F.regexp_count("_text", F.lit(SYMBOLS)) / chars,
        "capitals": F.regexp_count("_text", F.lit(CAPITALS)) / chars,
        "length": F.length("_text") / F.greatest(n, F.lit(1)),
    }
    bins = F.array(*(_bin(shape[k], ends) for k, ends in BINS.items()))
    return rows.withColumn("_tokens", n.cast("bigint")).withColumn("_bins", bins).drop("_all", "_text")


class Classifier:
    """Naive Bayes: log priors, log likelihoods of bins, and of marker words how much likelier each domain makes them. A missing
    marker says nothing: markers come in bundles, whose absence would be counted many times."""

    def __init__(self, domains: list[str], prior: list[float], bins: list[list[list[float]]], words: dict[str, list[float]]):
        self.domains, self.prior, self.bins, self.words = domains, prior, bins, words
        self.heat, self.shift = 1.0, [0.0] * len(domains)

    def logs(self) -> Column:
        """An array of log likelihoods in the order of the domains, of rows that described() made."""
        logs = []
        for d in range(len(self.domains)):
            at = F.lit(self.prior[d])
            for f in range(len(BINS)):
                at = at + F.element_at(F.array(*(F.lit(x[d]) for x in self.bins[f])), F.element_at("_bins", f + 1))
            logs.append(at)
        out = F.array(*logs)
        if self.words:
            table = F.map_from_arrays(F.array(*map(F.lit, self.words)), F.array(*(F.array(*map(F.lit, v)) for v in self.words.values())))
            hits = F.array_intersect("_words", F.array(*map(F.lit, self.words)))
            out = F.aggregate(hits, out, lambda acc, w: F.zip_with(acc, F.element_at(table, w), lambda a, b: a + b))
        return out

    def calibrate(self, logs: np.ndarray, truth: np.ndarray) -> None:
        """Fit heat and shift of softmax(heat * logs + shift) to the true domains (numbers) of left-out rows by Newton steps of the
        log loss; a ridge keeps them near 1 and 0 where few rows tell otherwise."""
        n, d = logs.shape
        if not n:
            return
        own = np.eye(d)[truth]
        x = np.concatenate((logs[:, :, None], np.broadcast_to(np.eye(d), (n, d, d))), axis=2)  # of each row and domain its features
        start = np.array([1.0] + [0.0] * d)

        def loss(beta: np.ndarray) -> tuple[float, np.ndarray]:
            z = x @ beta
            z = z - z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1)
            return float((np.log(total) - (own * z).sum(axis=1)).sum() + ((beta - start) ** 2).sum() / 2), p / total[:, None]

        beta = start
        value, p = loss(beta)
        for _ in range(100):
            mean = np.einsum("nd,ndk->nk", p, x)
            gradient = np.einsum("nd,ndk->k", p - own, x) + beta - start
            hessian = np.einsum("nd,ndj,ndk->jk", p, x, x) - mean.T @ mean + np.eye(d + 1)
            step = np.linalg.solve(hessian, gradient)
            while True:
                after, next_p = loss(beta - step)
                if after <= value or np.abs(step).max() < 1e-9:
                    break
                step = step / 2
            done = value - after < 1e-9 * (1 + abs(value))
            beta, value, p = beta - step, after, next_p
            if done:
                break
        self.heat, self.shift = max(float(beta[0]), 0.01), beta[1:].tolist()

    def rows(self, docs: DataFrame, text_col: str) -> DataFrame:
        """The rows with _tokens and _p, whose items are multiples of 1 / GRID that add up to 1; what rounding leaves goes to the likeliest."""
        at = F.zip_with(F.transform("_raw", lambda x: x * self.heat), F.array(*map(F.lit, self.shift)), lambda a, b: a + b)
        logs = described(docs, text_col).withColumn("_raw", self.logs()).drop("_words", "_bins").withColumn("_logs", at).drop("_raw")
        weights = logs.withColumn("_most", F.array_max("_logs")).withColumn("_w", F.transform("_logs", lambda x: F.exp(x - F.col("_most")))).drop("_logs", "_most")
        total = F.aggregate("_w", F.lit(0.0), lambda a, b: a + b)
        parts = weights.withColumn("_total", total).withColumn("_q", F.transform("_w", lambda x: F.floor(x / F.col("_total") * GRID))).drop("_w", "_total")
        rest = parts.withColumn("_rest", F.lit(GRID) - F.aggregate("_q", F.lit(0).cast("bigint"), lambda a, b: a + b)).withColumn("_best", F.array_position("_q", F.array_max("_q")))
        return rest.withColumn("_p", F.transform("_q", lambda x, k: (x + F.when(k + 1 == F.col("_best"), F.col("_rest")).otherwise(0)) / GRID)).drop("_q", "_rest", "_best")


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], domain: Column, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit and calibrate on at most FIT_ROWS labelled rows, taken in the order of a hash of their id."""
    known = labels.select(F.col(id_col).cast("bigint").alias("_key"), domain.alias("_domain")).where(F.col("_key").isNotNull() & F.col("_domain").isin(domains))
    few = known.groupBy("_key").agg(F.min("_domain").alias("_domain")).orderBy(F.xxhash64("_key"), "_key").limit(FIT_ROWS)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_key"), F.col(text_col).alias("_body")).join(F.broadcast(few), "_key")  # few has FIT_ROWS pairs at most
    # texts that share their least word-pair hash are copies and near copies: one of them speaks for all
    all_of_them = spool(described(rows, "_body", sketched=True).select("_domain", "_sketch", "_key", "_bins", "_words"))
    left_out = F.pmod(F.hash("_sketch"), F.lit(CALIBRATE)) == 0
    every = all_of_them.where(~left_out)
    one = every.groupBy("_sketch", "_domain").agg(F.min(F.struct("_key", "_bins", "_words")).alias("_one"))
    seen = spool(one.select("_domain", "_one._bins", "_one._words"))
    sizes = {r["_domain"]: r["count"] for r in seen.groupBy("_domain").count().collect()}
    total = sum(sizes.values())
    often = {r["_domain"]: r["count"] for r in every.groupBy("_domain").count().collect()}
    prior = [math.log((often.get(d, 0) + 1) / (sum(often.values()) + len(domains))) for d in domains]
    counts = {(r.f, r.b, r["_domain"]): r.n for r in seen.select("_domain", F.posexplode("_bins").alias("f", "b")).groupBy("f", "b", "_domain").agg(F.count("*").alias("n")).collect()}
    bins = []
    for f, ends in enumerate(BINS.values()):
        all_of = [(sum(counts.get((f, b, d), 0) for d in domains) + 1) / (total + len(ends) + 1) for b in range(1, len(ends) + 2)]
        bins.append([[math.log((counts.get((f, b, d), 0) + SMOOTHING * all_of[b - 1]) / (sizes.get(d, 0) + SMOOTHING)) for d in domains] for b in range(1, len(ends) + 2)])

    def gain(k: Column, d: str) -> Column:
        """What a word says of a domain: log likelihood ratio of its documents inside and outside."""
        inside, n = sizes.get(d, 0), F.col("n")
        expect = n * (inside / max(1, total))
        rest = n - k
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        return part(k, expect) + part(rest, n - expect) if 0 < inside < total else F.lit(0.0)

    by_word = seen.select("_domain", F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("_domain") == d, 1)).alias(f"k{i}") for i, d in enumerate(domains)))
    good = by_word.withColumn("gain", F.greatest(*(gain(F.col(f"k{i}"), d) for i, d in enumerate(domains))) if len(domains) > 1 else F.lit(0.0))
    top = good.where(F.col("gain") >= LEAST_GAIN).orderBy(F.col("gain").desc(), "word").limit(MARKERS).collect()
    words = {}
    for r in top:
        share = r.n / total  # what a domain without such documents is taken to have
        words[r.word] = [math.log((r[f"k{i}"] + SMOOTHING * share) / (sizes.get(d, 0) + SMOOTHING) / share) for i, d in enumerate(domains)]
    out = Classifier(domains, prior, bins, words)
    tests = all_of_them.where(left_out).select("_domain", out.logs().alias("logs")).collect()  # FIT_ROWS at most
    out.calibrate(np.array([r.logs for r in tests]).reshape(-1, len(domains)), np.array([domains.index(r["_domain"]) for r in tests], int))
    return out


@dataclass
class Fit:
    """The fitted rate as an expression over _p, and the expected tokens of each domain beside those aimed at."""

    rate: Column
    reached: list[float]
    aimed: list[float]
    steps: int
    converged: bool

    def told(self, domains: list[str]) -> bool:
        """Whether the targets are met; the tokens reached and aimed at are logged, a miss as a warning."""
        met = max(abs(a - b) for a, b in zip(self.reached, self.aimed, strict=True)) <= MET * sum(self.aimed)
        told = ", ".join(f"{d} {a:.0f} of {b:.0f} tokens" for d, a, b in zip(domains, self.reached, self.aimed, strict=True))
        logging.getLogger(__name__).log(logging.INFO if met else logging.WARNING, "targets %s after %d steps%s: %s", "met" if met else "missed", self.steps, "" if self.converged else ", not converged", told)
        return met


def fit_rates(rows: DataFrame, targets: list[float], least: float = 0.0, most: float = math.inf, budget: float = 1.0) -> Fit:
    """Fit the rates of rows (_tokens, _p). The targets are shares of budget times all tokens."""
    n, start = len(targets), min(max(1.0, least), most)
    grid = spool(rows.groupBy("_p").agg(F.sum("_tokens").cast("double").alias("_w")))  # read for each step
    p, w = [F.element_at("_p", d + 1) for d in range(n)], F.col("_w")
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))

    def rates(vector: np.ndarray) -> tuple[Column, Column]:
        """The rates before and after they are put into the bounds."""
        raw = F.lit(start)
        for d in range(n):
            raw = raw - p[d] * float(vector[d])
        return raw, F.greatest(F.lit(least), F.least(F.lit(most), raw))

    def at(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The totals, the matrix of the rows within the bounds, and the dual objective without its ridge."""
        raw, rate = rates(vector)
        inside = F.when((F.col("_raw") > least) & (F.col("_raw") < most), w).otherwise(0.0)
        got = grid.withColumn("_raw", raw).withColumn("_rate", rate).agg(
            *(total(w * x * F.col("_rate")) for x in p), *(total(inside * p[a] * p[b]) for a, b in pairs), total(w * F.col("_rate") * (2 * F.col("_raw") - F.col("_rate"))) / 2
        ).first()
        matrix = np.zeros((n, n))
        for (a, b), x in zip(pairs, got[n:], strict=False):
            matrix[a, b] = matrix[b, a] = x
        return np.array(got[:n]), matrix, got[-1]

    first = grid.agg(total(w), *(total(w * x * x) for x in p)).first()
    scale = max(1e-300, sum(first[1:]))
    aim = np.array(targets) * budget * first[0]
    vector, ridge, steps = np.zeros(n), 0.1 * scale, 0
    now, matrix, value = at(vector)
    while True:
        met = np.abs(now - aim).max() <= TOLERANCE * max(1.0, first[0])
        gradient = ridge * vector + aim - now
        settled = np.linalg.norm(gradient) <= 1e-3 * ridge * np.linalg.norm(vector)
        if met or settled and ridge <= RIDGE * scale or steps >= STEPS:
            return Fit(rates(vector)[1], now.tolist(), aim.tolist(), steps, bool(met or settled and ridge <= RIDGE * scale))
        if settled:
            ridge *= 0.1
            continue
        move = np.linalg.solve(matrix + ridge * np.eye(n), gradient)
        part = 1.0
        while True:
            after = vector - part * move
            reached, next_matrix, next_value = at(after)
            steps += 1
            before, then = value + aim @ vector + ridge / 2 * vector @ vector, next_value + aim @ after + ridge / 2 * after @ after
            if then <= before - 1e-4 * part * (gradient @ move) or part < 1e-6:
                break
            part /= 2
        vector, now, matrix, value = after, reached, next_matrix, next_value


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, n_tokens, rate, domain (the likeliest) and a posterior column p_<domain> for every document."""
    targets = targets or TARGETS
    domains = list(targets)
    classifier = fit_classifier(docs, labels, domains, label_domain())
    rows = spool(classifier.rows(docs.select(F.col(id_col).alias("doc_id"), "source", "text"), "text").drop("text"))
    fit = fit_rates(rows, list(targets.values()))
    fit.told(domains)
    best = F.element_at(F.array(*map(F.lit, domains)), F.array_position("_p", F.array_max("_p")).cast("int"))
    return rows.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), fit.rate.alias("rate"), best.alias("domain"), *(F.element_at("_p", d + 1).alias(f"p_{name}") for d, name in enumerate(domains)))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.25, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as often as their rates say, with their columns. The whole part of a rate is a number of copies, the rest the chance of one
    more, decided by a hash of id and text. Documents of domains below target have rates above 1 and all stay; those of domains above target have rates below 1, and the
    fit decides by how much; Fit.told() logs the totals. With least=1 none is lost, but domains above their share of the budget then miss their targets."""
    targets = targets or TARGETS
    classifier = fit_classifier(docs, labels, list(targets), label_domain(), id_col, text_col)
    rows = spool(classifier.rows(docs.select(whole_row(docs), F.col(text_col).alias("_body")), "_body").drop("_body"))
    fit = fit_rates(rows, list(targets.values()), least, budget=budget)
    fit.told(list(targets))
    chance = F.pmod(F.xxhash64(F.col("_doc").getField(id_col), F.col("_doc").getField(text_col)), F.lit(1_000_003)) / 1_000_003
    copies = rows.withColumn("_rate", fit.rate).withColumn("_copies", (F.floor("_rate") + F.when(F.col("_rate") - F.floor("_rate") > chance, 1).otherwise(0)).cast("int"))
    return copies.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*unpacked(docs))
