"""Language identification: accuracy on rows held out, and awkward rows."""

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SF, awkward_docs, needs_data
from pyspark.sql import functions as F

from panelyard.llm.language_id import (
    CELLS, accepted, best_temperature, fit_language_model, frequency_kernel, grams, fold_table, held_out, op2_language_id,
    predict_language, train_ftrl,
)


@needs_data
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op2_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r.lang == r.lang_pred for r in got if r.held_out]
    assert len(out) > 20 and np.mean(out) >= 0.95


def test_awkward_rows(spark):
    docs = awkward_docs(spark).selectExpr("*", "9 as score", "'x' as lang_pred")
    model = fit_language_model(docs.filter(~held_out()))
    got = {r.doc_id: r for r in predict_language(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[8].lang_pred == "und"
    assert got[3].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert got[2].lang_pred in {"en", "fr", "de"}
    assert predict_language(docs, model).count() == docs.count()
    assert docs.filter(accepted(model)).columns == docs.columns
    assert predict_language(docs.limit(0), model).count() == 0


def test_without_learnable_rows_all_are_undetermined(spark):
    docs = awkward_docs(spark)
    model = fit_language_model(docs.limit(0))
    assert {r.lang_pred for r in predict_language(docs, model).collect()} == {"und"}
    nameless = fit_language_model(docs.withColumn("lang", F.lit(None).cast("string")))
    assert nameless.languages == []


def plain_cells(text):
    """Cells of a text's grams, one by one."""
    seq, out = [], Counter()
    for ch in text or "":
        if unicodedata.category(ch)[0] == "L":
            seq.append(ord(ch.lower()[0]))
        elif seq and seq[-1]:
            seq.append(0)
    for order in (1, 2, 3):
        for i in range(len(seq) - order + 1):
            gram = seq[i:i + order]
            if (order == 1 and not gram[0]) or (order == 3 and not gram[1]):
                continue
            key = order
            for code in gram:
                key = (key * 0x110000 + code) % 2**64
            out[((key ^ key >> 29) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - 14)] += 1
    return out


def test_grams_do_not_depend_on_neighbours():
    texts = ["ends in a letter", "\"quoted\" at first", "", None, "x", "1 digit", "Ünï çödé. ", " lead", "...", "ab"]
    at, cells, _ = grams(texts, fold_table())
    for i, t in enumerate(texts):
        assert Counter(cells[at == i].tolist()) == plain_cells(t), t


@needs_data
def test_equals_a_plain_version(spark):
    """Dense follow-the-regularised-leader on counted grams: the query's languages and scores."""
    sf = SF.rsplit("/", 1)[0] + "/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.pmod(F.xxhash64("text", "doc_id") / 64, F.lit(5)).cast("int").alias("fold")
    rows = docs.select("*", fold).collect()
    learn = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    languages = sorted({r.lang for r in learn})
    assert max(Counter(r.lang for r in learn).values()) <= 1200   # all of them are the sample
    df = np.array([0.0] * CELLS)
    for r in learn:
        df[list(plain_cells(r.text))] += 1
    lettered = sum(bool(plain_cells(r.text)) for r in learn)
    idf = np.log((1.0 + lettered) / (1.0 + df)) + 1.0

    def features(text):
        x, found = np.zeros(CELLS + 1), plain_cells(text)
        for c, n in found.items():
            x[c] = 20.0 * n / sum(found.values()) * idf[c]
        x[CELLS] = 1.0
        return x

    sample = sorted({(r.lang, r.doc_id, r.text, r.fold) for r in learn if plain_cells(r.text)}, key=lambda r: (r[0], *map(list, zip(*sorted(plain_cells(r[2]).items())))))
    k, train = len(languages), [r for r in sample if r[3] != 0]
    z, n = np.zeros((CELLS + 1, k)), np.zeros((CELLS + 1, k))
    l1, l2 = np.full((CELLS + 1, 1), 1e-3), np.full((CELLS + 1, 1), 1e-4)
    l1[CELLS] = l2[CELLS] = 0

    def weights():
        return -np.sign(z) * np.maximum(0, np.abs(z) - l1) / ((1.0 + np.sqrt(n)) / 0.5 + l2)

    draw, xs = np.random.default_rng(7), [features(r[2]) for r in train]
    for _ in range(4):
        for i in draw.permutation(len(train)):
            w = weights()
            p = np.exp(xs[i] @ w - (xs[i] @ w).max())
            g = np.outer(xs[i], p / p.sum() - np.eye(k)[languages.index(train[i][0])])
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w
            n += g * g
    w = weights()
    held = [(features(r[2]) @ w, languages.index(r[0])) for r in sample if r[3] == 0]
    t = best_temperature(np.array([h[0] for h in held]).reshape(-1, k), np.array([h[1] for h in held], dtype=int))
    for r in op2_language_id(spark, sf).join(docs, "doc_id").collect():
        logits = features(r.text) @ w / t
        p = np.exp(logits - logits.max())
        want = (languages[int(logits.argmax())], p.max() / p.sum()) if plain_cells(r.text) else ("und", 0.0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6, r.doc_id


def test_frequencies_count_texts_once():
    total = frequency_kernel()(["aba ab", "zz", None, "1"])
    at, cells, letters = grams(["aba ab", "zz", None, "1"], fold_table())
    assert letters.tolist() == [True, True, False, False] and total[CELLS] == 2
    assert total[:CELLS].sum() == len({(a, c) for a, c in zip(at.tolist(), cells.tolist())})


def test_ftrl_separates_and_stays_sparse():
    draw = np.random.default_rng(0)
    rows, labels = [], draw.integers(0, 3, 300)
    for k in labels:
        at = np.r_[k, 100 + draw.integers(0, 50), CELLS]
        rows.append((at, np.array([1.0, 0.2, 1.0])))
    w = train_ftrl(rows, labels, 3)
    assert all(w[k].argmax() == k for k in range(3)) and (w[200:CELLS] == 0).all()


def test_temperature_undoes_scaling():
    draw = np.random.default_rng(1)
    logits = draw.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([draw.choice(3, p=row) for row in p])
    assert abs(best_temperature(5 * logits, labels) - 5) < 0.6


def test_repeated_rows_do_not_displace_others(spark):
    """One row repeated often, drawn as a whole: the sample is that of the distinct rows."""
    rows = [(i, f"der hund {'abcdefgh'[i % 8]} und die katze", "de") for i in range(8)]
    rows += [(i, f"the dog {'abcdefgh'[i % 8]} and the cat", "en") for i in range(8, 16)]
    kind = "doc_id long, text string, lang string"
    once = fit_language_model(spark.createDataFrame(rows, kind), per_language=8)
    idf_of_rows = spark.createDataFrame(rows[:1] * 200 + rows, kind)
    seen = []
    import panelyard.llm.language_id as module

    train, module.train_ftrl = module.train_ftrl, lambda r, y, k: seen.append(len(r)) or train_ftrl(r, y, k)
    try:
        fit_language_model(idf_of_rows, per_language=8)
        fit_language_model(spark.createDataFrame(rows, kind), per_language=8)
    finally:
        module.train_ftrl = train
    assert once.languages == ["de", "en"] and seen[0] == seen[1] > 0


def test_more_languages_than_before(spark):
    """1100 languages fit within the sample of all; nothing raises."""
    rows = [(i, f"word{i % 1100} {'abcdefghij'[i % 10] * 5}", f"l{i % 1100}") for i in range(2200)]
    model = fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 1100


def test_scratch_needs_a_shared_folder_off_this_machine():
    from panelyard.llm.common import scratch_dir

    class Session:
        class conf:
            values = {"spark.master": "spark://somewhere:7077"}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session)
    Session.conf.values["spark.checkpoint.dir"] = "hdfs://shared/x"
    assert scratch_dir(Session).startswith("hdfs://shared/x/")
