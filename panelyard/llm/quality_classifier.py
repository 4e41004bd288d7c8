"""Operator 3, quality classifier: positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a linear model by minimising the
non-negative unbiased risk: pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]) with the
logistic loss, so that sigmoid(g) estimates the probability of label 1. The class prior pi is
estimated from all texts that may be learnt from: the best-bin bound on their scores by a first
model that tells positives from unlabelled text, counted in a histogram of fixed bins. The first
model is cross-fitted: a text's fold is a hash of the text, and the model that scores it was
fitted on the sampled rows of the other folds. Where the sample has too few rows of a kind for
that, one first model of all sampled rows scores every text.

Features are shares of "shape" 1- to 4-grams (letters become a or A, digits 0, space kinds and
other characters stay, runs of one class in a word shortened to three) hashed to cells, and a
few ratios. Their means and deviations come from all texts that may be learnt from; the weights
are fitted on bounded samples of ROWS rows of each kind, chosen by hash.

Defined results. Text NULL counts as empty; empty texts get a score too (all features 0). Only
label 1 of learnable rows is used; label 0, toxic, lang, source and ids are not. Without any
positive row every score is 0.5. Several labels of one document: it is positive if any is 1.
Equal texts get equal results. Very long texts count whole. An empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import arrow_column, code_points, crc_remainder, vector_sum, worker_cache
from panelyard.llm.registry import query

CELLS = 1024
ORDERS = (1, 2, 3, 4)
RATIOS = 8
SIZE = CELLS + RATIOS
ROWS = 6000              # sampled rows of each kind: the bound of the fit
FOLDS = 4                # of the cross-fitted first model
BINS, REACH = 4096, 16.0   # histogram of first scores: equal bins from -REACH to REACH
STEPS = 600
BATCH = 512
RATE = 0.02
DECAY = 1e-4
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shape_table() -> np.ndarray:
    """Code point -> its shape: a, A, 0, or itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            table[code] = ord("A") if kind in ("Lu", "Lt") else ord("a")
        elif kind[0] == "N":
            table[code] = ord("0")
    return table


def features(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """A row of SIZE numbers for each text."""
    n = len(texts)
    out = np.zeros((n, SIZE), dtype=np.float32)
    codes, bounds = code_points(texts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    shape = table[codes]
    size = np.maximum(1, np.diff(bounds))
    upper, digit, lower = shape == ord("A"), shape == ord("0"), shape == ord("a")
    space = (codes <= 32) & ((codes == 32) | ((codes >= 9) & (codes <= 13)))
    mark = ~(upper | digit | lower | space)
    for j, flag in enumerate((upper, digit, mark, space)):
        out[:, CELLS + j] = np.bincount(owner[flag], minlength=n) / size
    # Words: their number, mean length, share of repeats next to each other and of all repeats.
    for i, t in enumerate(texts):
        words = (t or "").split()
        if words:
            out[i, CELLS + 4] = np.log1p(len(words)) / 10
            out[i, CELLS + 5] = min(50.0, len(t) / len(words)) / 10
            out[i, CELLS + 6] = 1 - np.log1p(len(set(words))) / np.log1p(len(words))
            out[i, CELLS + 7] = sum(map(str.__eq__, words, words[1:])) / len(words)
    # Runs of one shape shortened to three: longer words look alike.
    same = np.r_[False, (shape[1:] == shape[:-1]) & (owner[1:] == owner[:-1])] if len(shape) else np.zeros(0, bool)
    long_run = same & np.r_[False, same[:-1]] & np.r_[False, False, same[:-2]] if len(shape) > 2 else np.zeros(len(shape), bool)
    shape, owner = shape[~long_run].astype(np.uint64), owner[~long_run]
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    total = np.zeros(n * CELLS)
    for order in ORDERS:
        m = len(shape) - order + 1
        if m <= 0:
            continue
        key = np.full(m, order, dtype=np.uint64)
        for j in range(order):
            key = key * np.uint64(1000003) + shape[j:j + m]
        ok = owner[:m] == owner[order - 1:]
        cell = (((key[ok] ^ (key[ok] >> np.uint64(29))) * _MULT) >> shift).astype(np.int64)
        total += np.bincount(owner[:m][ok] * CELLS + cell, minlength=n * CELLS)
    counts = total.reshape(n, CELLS)
    out[:, :CELLS] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    return out


def blocks(texts: list, table: np.ndarray):
    for lo in range(0, len(texts), 128):
        yield features(texts[lo:lo + 128], table)


def moment_kernel():
    """Sums, sums of squares, and the number of texts."""
    table = worker_cache("quality_classifier", "shape_table", shape_table)

    def run(texts):
        total = np.zeros(2 * SIZE + 1)
        for x in blocks(texts, table):
            x = x.astype(np.float64)
            total[:SIZE] += x.sum(axis=0)
            total[SIZE:2 * SIZE] += (x * x).sum(axis=0)
            total[2 * SIZE] += len(x)
        return total

    return run


def feature_kernel():
    table = worker_cache("quality_classifier", "shape_table", shape_table)

    def run(texts):
        return ([row.tobytes() for x in blocks(texts, table) for row in x],)

    return run


def fit_pu(rows: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 11) -> np.ndarray:
    """Weights (last: bias) by Adam on the non-negative risk of the rows numbered ``positive``
    and ``unlabelled``; with ``prior`` None, plain logistic regression of the one kind against
    the other, each weighing half."""
    draw = np.random.default_rng(seed)
    w = np.zeros(rows.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        p = rows[positive[draw.integers(0, len(positive), min(BATCH, len(positive)))]].astype(np.float64)
        u = rows[unlabelled[draw.integers(0, len(unlabelled), min(BATCH, len(unlabelled)))]].astype(np.float64)
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        as_positive = p.T @ (sp - 1) / len(p)     # gradient of E_p[l(g)]
        as_negative = p.T @ sp / len(p)           # of E_p[l(-g)]
        unlabelled_negative = u.T @ su / len(u)   # of E_u[l(-g)]
        if prior is None:
            g = 0.5 * as_positive + 0.5 * unlabelled_negative
        else:
            negative = softplus(u @ w).mean() - prior * softplus(p @ w).mean()
            if negative >= 0:
                g = prior * as_positive + unlabelled_negative - prior * as_negative
            else:   # the risk of negatives cannot be below 0: step back from where it is
                g = prior * as_negative - unlabelled_negative
        g = g + DECAY * w
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        rate = RATE * (1 - 0.9 * step / STEPS)
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def score_bins(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def prior_of_counts(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best bin, from the number of rows in each bin of the score: the top bins hold a share q_u
    of unlabelled and q_p of positive rows; where they are all positive, q_u / q_p is the prior.
    The least ratio with its margin decides."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    margin = np.sqrt(np.log(20) / (2 * n_u)) + np.sqrt(np.log(20) / (2 * n_p))
    top_p, top_u = np.cumsum(positive[::-1])[::-1], np.cumsum(unlabelled[::-1])[::-1]
    some = top_p > 0
    q_p, q_u = top_p[some] / n_p, top_u[some] / n_u
    i = int(np.argmin(q_u / q_p + margin / q_p))
    return float(np.clip(q_u[i] / q_p[i], 0.05, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """``prior_of_counts`` for scores at hand."""
    return prior_of_counts(*(np.bincount(score_bins(s), minlength=BINS) for s in (positive, unlabelled)))


def fold_of(text: str = "text") -> Column:
    """By the text alone: copies of a text of the fit are not scored by its model either."""
    return F.pmod(F.xxhash64(text, F.lit(1)), F.lit(FOLDS)).cast("int")


def bin_kernel(weights: np.ndarray):
    """Kernel: (texts, folds) -> the bin of each text's score by its fold's row of ``weights``."""

    def kernel():
        table = worker_cache("quality_classifier", "shape_table", shape_table)

        def run(texts, folds):
            parts = [x.astype(np.float64) @ weights[:, :-1].T + weights[:, -1] for x in blocks(texts, table)]
            score = np.concatenate(parts) if parts else np.zeros((0, len(weights)))
            return (score_bins(score[np.arange(len(texts)), np.array(folds, dtype=np.int64)]),)

        return run

    return kernel


def first_counts(docs: DataFrame, trusted: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive and unlabelled rows in each bin of the first score, over all of ``docs``. Keys
    and bins only are shuffled."""
    binned = docs.select("key", arrow_column(bin_kernel(weights), "bin int", "text", fold_of())["bin"].alias("bin"))
    counted = binned.join(trusted, "key", "left").groupBy("bin").agg(
        F.count("trusted").alias("p"), F.count(F.when(F.col("trusted").isNull(), 1)).alias("u")
    )
    positive, unlabelled = np.zeros(BINS), np.zeros(BINS)
    for row in counted.collect():
        positive[row["bin"]], unlabelled[row["bin"]] = row["p"], row["u"]
    return positive, unlabelled


@dataclass
class QualityModel:
    weights: np.ndarray   # on raw features; the last is the bias
    prior: float

    def column(self, text: str | Column) -> Column:
        weights = self.weights

        def kernel():
            table = worker_cache("quality_classifier", "shape_table", shape_table)

            def run(texts):
                parts = [sigmoid(x.astype(np.float64) @ weights[:-1] + weights[-1]) for x in blocks(texts, table)]
                return (np.concatenate(parts) if parts else np.zeros(0),)

            return run

        return arrow_column(kernel, "score double", text)["score"]


def fit_quality(learnable: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> QualityModel:
    """``learnable``: texts that may be learnt from; ``positives``: keys of trusted ones."""
    docs = learnable.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    trusted = positives.select(F.col(f"`{key}`").alias("key")).dropna().distinct().withColumn("trusted", F.lit(1))
    # Keys and labels only: texts are not shuffled for this.
    marked = docs.select("key").join(trusted, "key", "left").agg(
        F.count("trusted").alias("p"), F.count(F.when(F.col("trusted").isNull(), 1)).alias("u")
    ).first()
    if not marked["p"] or not marked["u"]:
        return QualityModel(np.zeros(SIZE + 1), 0.5)
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    chosen = trusted.filter(draw < min(1.0, rows / marked["p"])).orderBy(draw, "key").limit(2 * rows).select("key", F.lit(True).alias("positive"))
    others = docs.select("key").filter(draw < min(1.0, rows / marked["u"])).join(trusted, "key", "left_anti")
    chosen = chosen.union(others.distinct().orderBy(draw, "key").limit(2 * rows).select("key", F.lit(False)))
    # At most 4 * rows keys, and of rows with one key a single text, chosen by itself: however often
    # an id repeats and however the rows lie, the same rows fit the model.
    sampled = docs.join(F.broadcast(chosen), "key").groupBy("key", "positive").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    )
    made = sampled.select("positive", fold_of().alias("fold"),
                          F.xxhash64("key", "text").alias("place"), arrow_column(feature_kernel, "x binary", "text")["x"].alias("x"))
    got = made.toArrow()
    place, positive, fold = (np.array(got.column(c).to_pylist()) for c in ("place", "positive", "fold"))
    order = np.argsort(place, kind="stable")
    positive, fold = positive[order].astype(bool), fold[order]
    z = np.ones((len(order), SIZE + 1), dtype=np.float32)   # one copy, in single precision
    to = np.argsort(order, kind="stable")
    for i, row in enumerate(got.column("x")):
        z[to[i], :SIZE] = np.frombuffer(row.as_buffer(), dtype=np.float32)
    del got

    sums = vector_sum(docs, moment_kernel, "text", 2 * SIZE + 1)
    n = max(1.0, sums[-1])
    mean = sums[:SIZE] / n
    deviation = np.sqrt(np.maximum(0.0, sums[SIZE:2 * SIZE] / n - mean * mean))
    scale = np.where(deviation > 1e-6, 1.0 / np.maximum(deviation, 1e-6), 0.0)
    np.subtract(z[:, :SIZE], mean, out=z[:, :SIZE], casting="same_kind")
    z[:, :SIZE] *= scale
    np.clip(z[:, :SIZE], -8, 8, out=z[:, :SIZE])
    z[:, :SIZE] *= 4 / np.sqrt(SIZE)
    kinds = positive, ~positive
    if min(kind.sum() for kind in kinds) == 0:
        return QualityModel(np.zeros(SIZE + 1), 0.5)
    crossed = min((kind & (fold == f)).sum() for kind in kinds for f in range(FOLDS)) >= 5
    sides = [fold != f for f in range(FOLDS)] if crossed else [np.ones(len(z), dtype=bool)]
    firsts = [fit_pu(z, *(np.flatnonzero(kind & side) for kind in kinds), None) for side in sides]

    def raw(w):   # weights on raw features
        own = w[:-1] * scale * 4 / np.sqrt(SIZE)
        return np.r_[own, w[-1] - own @ mean]

    weights = np.array([raw(firsts[f if crossed else 0]) for f in range(FOLDS)])
    prior = prior_of_counts(*first_counts(docs, trusted, weights))
    w = fit_pu(z, np.flatnonzero(positive), np.flatnonzero(~positive), prior)
    return QualityModel(raw(w), prior)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(crc_remainder(key, 3) == 1, F.lit(False))


@query()
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs.filter(~held_out()), labels.filter((F.col("quality") == 1) & ~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.column("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
