"""Positive-unlabelled learning: ranking of held-out labels, prior, awkward rows."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SF, awkward_docs, needs_data

import panelyard.llm.quality_classifier as quality
from panelyard.llm.quality_classifier import SIZE, estimate_prior, features, fit_pu, fit_quality, op3_quality_classifier, shape_table, sigmoid


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@needs_data
def test_query(spark):
    sf = SF.replace("0.001", "0.01")
    rows = op3_quality_classifier(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    out = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, label = np.array([x[0] for x in out]), np.array([x[1] for x in out])
    assert auc(score, label) > 0.9


def samples(prior, n=4000, seed=0):
    draw = np.random.default_rng(seed)
    positive = draw.normal(1.5, 1, (n, 2))
    many = draw.random(n) < prior
    unlabelled = np.where(many[:, None], draw.normal(1.5, 1, (n, 2)), draw.normal(-1.5, 1, (n, 2)))
    return np.c_[positive, np.ones(n)], np.c_[unlabelled, np.ones(n)], many


def test_prior_and_risk():
    positive, unlabelled, truth = samples(0.6)
    rows, p, u = np.r_[positive, unlabelled], np.arange(len(positive)), np.arange(len(positive), 2 * len(positive))
    first = fit_pu(rows, p, u, None)
    prior = estimate_prior(positive @ first, unlabelled @ first)
    assert abs(prior - 0.6) < 0.08
    w = fit_pu(rows, p, u, prior)
    assert np.mean((sigmoid(unlabelled @ w) >= 0.5) == truth) > 0.95


def test_features_are_of_whole_texts():
    table = shape_table()
    a = features(["x " * 3000 + "y " * 3000, None, "", "Ab1!"], table)
    b = features(["x " * 3000 + "$%& " * 3000], table)
    assert a.shape == (4, SIZE) and (a[1] == 0).all() and (a[2] == 0).all() and np.abs(a[0] - b[0]).max() > 0.1


def test_awkward_rows(spark):
    docs = awkward_docs(spark).selectExpr("*", "1 as score", "2 as trusted", "3 as x")
    marks = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    model = fit_quality(docs, marks)
    got = docs.select("doc_id", model.column("text").alias("p")).collect()
    assert len(got) == docs.count() and all(0 <= r.p <= 1 for r in got)
    none = fit_quality(docs, marks.limit(0))
    assert {r.p for r in docs.select(none.column("text").alias("p")).collect()} == {0.5}
    assert docs.limit(0).select(model.column("text").alias("p")).count() == 0


@pytest.mark.parametrize("rows", [40, 6000])
def test_prior_is_of_all_learnable_rows(spark, monkeypatch, rows):
    """The counts hold every learnable row, whatever the bound of the fit; each text is scored by
    a model of other folds' rows."""
    draw, texts = np.random.default_rng(5), []
    for i in range(1200):
        good = i < 300 or i % 2
        words = [f"word{chr(97 + j)}" if good else f"{j}#!" for j in draw.integers(0, 26, 30)]
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seen, fitted = [], []
    counts, fit = quality.prior_of_counts, quality.fit_pu
    monkeypatch.setattr(quality, "prior_of_counts", lambda p, u: seen.append((p.sum(), u.sum())) or counts(p, u))
    monkeypatch.setattr(quality, "fit_pu", lambda z, p, u, prior: fitted.append(len(p) + len(u)) or fit(z, p, u, prior))
    model = fit_quality(docs, docs.filter("doc_id < 300").select("doc_id"), rows=rows)
    assert seen == [(300, 900)] and abs(model.prior - 0.5) < 0.15
    assert len(fitted) == quality.FOLDS + 1 and max(fitted[:-1]) < fitted[-1]


def test_one_id_on_very_many_rows(spark):
    """Which rows fit the model does not hang on how the rows lie."""
    import numpy as np

    rows = [(i, f"text number {i} with some words, and {'more' * (i % 5)}.") for i in range(400)]
    rows += [(7, f"another text {i} under one id {'!' * (i % 9)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 400, 3)] + [(7,)], "doc_id long")
    a, b = (fit_quality(df.repartition(n), good, rows=60) for n in (3, 8))
    assert np.abs(a.weights).sum() > 0 and np.allclose(a.weights, b.weights, atol=1e-6) and a.prior == pytest.approx(b.prior)


def plain_features(text):
    """One text's numbers, character by character."""
    text, out = text or "", np.zeros(SIZE)
    kinds = [unicodedata.category(c) for c in text]
    shape = ["A" if k in ("Lu", "Lt") else "a" if k[0] == "L" else "0" if k[0] == "N" else c for c, k in zip(text, kinds)]
    blank = sum(c in " \t\n\v\f\r" for c in text)
    upper, lower, digit = (shape.count(x) for x in "Aa0")
    size = max(1, len(text))
    out[quality.CELLS:quality.CELLS + 4] = upper / size, digit / size, (len(text) - upper - lower - digit - blank) / size, blank / size
    words = text.split()
    if words:
        again = sum(a == b for a, b in zip(words, words[1:]))
        out[quality.CELLS + 4:] = (np.log1p(len(words)) / 10, min(50.0, len(text) / len(words)) / 10,
                                   1 - np.log1p(len(set(words))) / np.log1p(len(words)), again / len(words))
    short = []
    for c in shape:
        run = len(short) >= 3 and short[-3:] == [c] * 3
        if not run:
            short.append(c)
    cells, full = Counter(), (1 << 64) - 1
    for order in quality.ORDERS:
        for i in range(len(short) - order + 1):
            key = order
            for c in short[i:i + order]:
                key = (key * 1000003 + ord(c)) & full
            cells[(((key ^ (key >> 29)) * 0x9E3779B97F4A7C15) & full) >> 54] += 1
    for cell, count in cells.items():
        out[cell] = np.sqrt(count / sum(cells.values()))
    return out


def plain_fit(p, u, prior):
    """Adam on the risk, its gradient row by row of the definition."""
    draw, w = np.random.default_rng(11), np.zeros(p.shape[1])
    m, v = w.copy(), w.copy()
    for t in range(1, quality.STEPS + 1):
        a = p[draw.integers(0, len(p), min(quality.BATCH, len(p)))]
        b = u[draw.integers(0, len(u), min(quality.BATCH, len(u)))]
        ga, gb = a @ w, b @ w
        up = -(a / (1 + np.exp(ga))[:, None]).mean(axis=0)
        down_a, down_b = ((x / (1 + np.exp(-g))[:, None]).mean(axis=0) for x, g in ((a, ga), (b, gb)))
        if prior is None:
            g = (up + down_b) / 2
        else:
            risk = np.log1p(np.exp(gb)).mean() - prior * np.log1p(np.exp(ga)).mean()
            g = prior * up + down_b - prior * down_a if risk >= 0 else prior * down_a - down_b
        g = g + quality.DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - quality.RATE * (1 - 0.9 * t / quality.STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@needs_data
def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "doc_id", "coalesce(text, '') AS text", "xxhash64(doc_id, coalesce(text, '')) AS place",
        f"pmod(xxhash64(coalesce(text, ''), 1), {quality.FOLDS}) AS fold").collect()
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len({r.doc_id for r in docs}) == len(docs) <= quality.ROWS   # so that all of them are in the sample
    every = {r.doc_id: plain_features(r.text) for r in docs}
    learnt = sorted((r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 != 1), key=lambda r: r.place)
    x = np.array([every[r.doc_id] for r in learnt])
    positive, fold = np.array([r.doc_id in good for r in learnt]), np.array([r.fold for r in learnt])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0)
    z = np.c_[np.clip((x - mean) * scale, -8, 8) * 4 / np.sqrt(SIZE), np.ones(len(x))]

    def score(w, rows):   # scores are of features that are not clipped
        return ((rows - mean) * scale * 4 / np.sqrt(SIZE)) @ w[:-1] + w[-1]

    first = np.zeros(len(x))
    for f in range(quality.FOLDS):
        side = fold != f
        first[~side] = score(plain_fit(z[side & positive], z[side & ~positive], None), x[~side])
    edges = np.clip(np.floor((first + quality.REACH) * quality.BINS / (2 * quality.REACH)), 0, quality.BINS - 1)
    n_p, n_u = positive.sum(), (~positive).sum()
    margin = np.sqrt(np.log(20) / (2 * n_u)) + np.sqrt(np.log(20) / (2 * n_p))
    best = min(
        ((q_u + margin) / q_p, q_u / q_p)
        for q_p, q_u in (((edges[positive] >= e).mean(), (edges[~positive] >= e).mean()) for e in np.unique(edges)) if q_p > 0
    )[1]
    w = plain_fit(z[positive], z[~positive], float(np.clip(best, 0.05, 0.98)))
    for r in op3_quality_classifier(spark, SF).collect():
        assert r.score == pytest.approx(1 / (1 + np.exp(-score(w, every[r.doc_id]))), abs=2e-3)
