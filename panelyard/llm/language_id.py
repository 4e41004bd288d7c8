"""Operator 2, language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with an elastic net, then
calibrated by one temperature.

Text is folded to lower-case letters with single gaps; its 1-, 2- and 3-grams (none longer than
a word with its gaps) are hashed to cells. A cell's feature is its share of the text's grams
times its inverse document frequency. Document frequencies come from every learnable text; the
weights are fitted on a bounded sample of them (PER_LANGUAGE rows per language, chosen by hash
of id and text, the same rows wherever the job runs; rows equal in id, text and language are one).

Defined results. Text NULL or without a letter (Unicode category L): ``und`` with score 0.
Learnable are rows with text, language and id that are not held out. Without any learnable
language every row is ``und``. Ties go to the alphabetically first language. Equal texts get
equal results; row order and other columns have no influence. Very long texts count whole.
An empty table gives an empty table. Input columns called like those added are replaced.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import arrow_column, code_points, crc_remainder, vector_sum, worker_cache
from panelyard.llm.registry import query

CELLS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1200      # sampled rows per language, and
SAMPLE = 60_000          # of all languages: the bounds of the fit; a language has LEAST_ROWS at least
LEAST_ROWS = 8
BROADCAST = 100_000      # languages whose shares are broadcast
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
SCALE = 20.0             # of the features: shares of grams are small numbers
VALIDATION = 5           # every fifth sampled row calibrates
MIN_SCORE = 0.3          # pipeline: below it a document is rejected
UNDETERMINED = "und"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def fold_table() -> np.ndarray:
    """Code point -> code point of its lower case, or 0 where it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == "L":
            low = chr(code).lower()
            table[code] = ord(low[0])
    return table


def grams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each gram, cell of each gram, whether each text has a letter)."""
    codes, bounds = code_points(texts)
    folded = table[codes]
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    letters = np.bincount(owner[folded > 0], minlength=len(texts)) > 0
    # One gap after each word, none repeated; what stands before a text plays no part.
    after = np.r_[False, folded[:-1] > 0][: len(folded)]
    after[bounds[:-1][np.diff(bounds) > 0]] = False
    keep = (folded > 0) | after
    folded, owner = folded[keep].astype(np.uint64), owner[keep]
    at, cells = [], []
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    for order in ORDERS:
        n = len(folded) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, dtype=np.uint64)
        for j in range(order):
            key = key * np.uint64(0x110000) + folded[j:j + n]
        ok = owner[:n] == owner[order - 1:]
        if order > 1:   # a gap only at an end
            for j in range(1, order - 1):
                ok &= folded[j:j + n] > 0
        else:
            ok &= folded[:n] > 0
        at.append(owner[:n][ok])
        cells.append((((key[ok] ^ (key[ok] >> np.uint64(29))) * _MULT) >> shift).astype(np.int64))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    return np.concatenate(at), np.concatenate(cells), letters


def frequency_kernel():
    """Documents per cell; the last cell counts the documents."""
    table = worker_cache("language_id", "fold_table", fold_table)

    def run(texts):
        total = np.zeros(CELLS + 1)
        for lo in range(0, len(texts), 64):
            part = texts[lo:lo + 64]
            at, cells, letters = grams(part, table)
            seen = np.unique(at * CELLS + cells) if len(at) < len(part) * CELLS // 20 else None
            if seen is None:
                mark = np.zeros((len(part), CELLS), dtype=bool)
                mark.reshape(-1)[at * CELLS + cells] = True
                total[:CELLS] += mark.sum(axis=0)
            else:
                total[:CELLS] += np.bincount(seen % CELLS, minlength=CELLS)
            total[CELLS] += letters.sum()
        return total

    return run


@dataclass
class LanguageModel:
    """``weights`` hold TF-IDF scale and temperature: logits are their mean over the grams."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def kernel(self):
        languages, weights, bias = self.languages, self.weights, self.bias

        def build():
            table = worker_cache("language_id", "fold_table", fold_table)

            def run(texts):
                best, score = [], []
                for lo in range(0, len(texts), 256):
                    part = texts[lo:lo + 256]
                    at, cells, letters = grams(part, table)
                    number = np.maximum(1, np.bincount(at, minlength=len(part)))
                    logits = np.empty((len(part), len(languages)))
                    for k in range(len(languages)):
                        logits[:, k] = np.bincount(at, weights=weights[k][cells], minlength=len(part)) / number + bias[k]
                    if languages:
                        p = softmax(logits)
                        top = p.argmax(axis=1)
                        best += [languages[k] if ok else UNDETERMINED for k, ok in zip(top, letters)]
                        score += np.where(letters, p[np.arange(len(part)), top], 0.0).tolist()
                    else:
                        best += [UNDETERMINED] * len(part)
                        score += [0.0] * len(part)
                return best, score

            return run

        return build


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, epochs: int = EPOCHS, seed: int = 7):
    """Proximal follow-the-regularised-leader; cell CELLS is the bias, without penalties."""
    z, n = np.zeros((CELLS + 1, k)), np.zeros((CELLS + 1, k))
    l1, l2 = np.full((CELLS + 1, 1), L1), np.full((CELLS + 1, 1), L2)
    l1[CELLS] = l2[CELLS] = 0.0

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(0.0, np.abs(z[at]) - l1[at])
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + l2[at])

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = np.outer(x, p)
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    return weights(np.arange(CELLS + 1))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section over its log. One
    pseudo-row of unknown language keeps a flawless calibration set from claiming certainty."""
    if not len(labels):
        return 1.0
    unknown = 1.0 / (len(labels) + 1)

    def loss(log_t):
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1)
        norm = top + np.log(np.exp(scaled - top[:, None]).sum(axis=1))
        known = scaled[np.arange(len(labels)), labels]
        return float(np.mean(norm - (1 - unknown) * known - unknown * scaled.mean(axis=1)))

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def sample_kernel():
    table = worker_cache("language_id", "fold_table", fold_table)

    def run(texts):
        cells, counts = [], []
        for t in texts:
            found, number = np.unique(grams([t], table)[1], return_counts=True)
            cells.append(found.tolist())
            counts.append(number.tolist())
        return cells, counts

    return run


def fit_language_model(learnable: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on rows that may be learnt from; rows with a NULL in a needed column take no part."""
    rows = learnable.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")
    ).dropna()
    place = F.xxhash64("key", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.countDistinct(place).alias("n")).collect()}
    per_language = min(per_language, max(LEAST_ROWS, SAMPLE // max(1, len(sizes))))
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((0, CELLS)), np.zeros(0), 1.0)
    frequency = vector_sum(rows, frequency_kernel, "text", CELLS + 1)
    idf = np.log((1.0 + frequency[CELLS]) / (1.0 + frequency[:CELLS])) + 1.0

    # A row per language, in hand already: broadcast up to a number of them, so that no text is shuffled.
    shares = [(lang, min(1.0, per_language / n)) for lang, n in sizes.items()]
    share = rows.sparkSession.createDataFrame(shares, "lang string, share double")
    share = F.broadcast(share) if len(shares) <= BROADCAST else share
    draw = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    # Repeated rows are drawn together and made one here, so the number drawn has its bound.
    chosen = rows.join(share, "lang").filter(draw < F.col("share")).groupBy("lang", place.alias("place")).agg(
        F.first("key").alias("key"), F.first("text").alias("text")
    )
    sample = chosen.select(
        "lang", F.pmod(F.xxhash64("text", "key") / 64, F.lit(VALIDATION)).cast("int").alias("fold"),
        arrow_column(sample_kernel, "cells array<int>, counts array<int>", "text").alias("x"),
    ).select("lang", "fold", "x.cells", "x.counts").toArrow()
    sample = {"lang": sample["lang"].to_pylist(), "fold": sample["fold"].to_pylist(), "cells": lists(sample["cells"]), "counts": lists(sample["counts"])}

    number = {lang: i for i, lang in enumerate(languages)}
    train, calibrate = ([], []), ([], [])
    order = sorted(range(len(sample["lang"])), key=lambda i: (sample["lang"][i], sample["cells"][i].tolist(), sample["counts"][i].tolist()))
    for i in order:
        cells, counts = np.array(sample["cells"][i], dtype=np.int64), np.array(sample["counts"][i], dtype=float)
        if not len(cells):
            continue
        at = np.r_[cells, CELLS]
        x = np.r_[SCALE * counts / counts.sum() * idf[cells], 1.0]
        rows_, labels = calibrate if sample["fold"][i] == 0 else train
        rows_.append((at, x))
        labels.append(number[sample["lang"][i]])
    weights = train_ftrl(train[0], np.array(train[1], dtype=int), len(languages))
    logits = np.array([x @ weights[at] for at, x in calibrate[0]]).reshape(-1, len(languages))
    temperature = best_temperature(logits, np.array(calibrate[1], dtype=int))
    scaled = (weights[:CELLS] * idf[:, None] * SCALE / temperature).T.copy()
    return LanguageModel(languages, scaled, weights[CELLS] / temperature, temperature)


def lists(column) -> list[np.ndarray]:
    """The lists of an Arrow column as views of one array."""
    flat = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    values, edges = flat.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(flat.value_lengths().to_numpy())]
    return [values[a:b] for a, b in zip(edges[:-1], edges[1:])]


def language_column(model: LanguageModel, text: str | Column = "text") -> Column:
    """A struct of ``lang_pred`` and ``score``."""
    return arrow_column(model.kernel(), "lang_pred string, score double", text)


def accepted(model: LanguageModel, text: str = "text", least: float = MIN_SCORE) -> Column:
    """True for texts with a language of at least that score."""
    found = language_column(model, F.col(f"`{text}`").cast("string"))
    return found["score"] >= least


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``. One narrow pass."""
    out = ("lang_pred", "score")
    rest = [c for c in docs.columns if c.lower() not in out]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("#text"))
    made = source.withColumn("#lang", language_column(model, "#text"))
    return made.select(*[F.col(f"`{c}`") for c in rest], "`#lang`.lang_pred", "`#lang`.score")


def held_out(key: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(crc_remainder(key, 4) == 2, F.lit(False))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs.filter(~held_out()))
    found = predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
