"""Packing: ids as the tokenizer library gives them, offsets, bounds."""

import zlib

import numpy as np
from llm_helpers import SF, awkward_docs, needs_data
from hypothesis import given, settings
from hypothesis import strategies as st

import panelyard.llm.packing as packing
from panelyard.llm.common import Memo, tokenizer_path
from panelyard.llm.packing import (
    VOCABULARY, best_fit_decreasing, lower_bound, op1_best_fit_packing, pack, texts_ids, tokenized_pieces, word_ids,
)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abs'tTLl <|>eof\n\téßİΣσﬁ中٣½\x1c\xa0"), st.characters(codec="utf-8"))), max_size=3))
def test_ids_are_the_librarys(texts):
    t = tokenizer.cached = getattr(tokenizer, "cached", None) or tokenizer()
    got = texts_ids([*texts, None, ""], t, Memo(100, word_ids(t)))
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in [*texts, None, ""]]
    assert got == want


def minimum_bins(sizes, capacity):
    """Exact, by branching over bins."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bound_and_best_fit(sizes):
    a = np.array(sizes)
    bins, offsets, fill = best_fit_decreasing(a, 12)
    least = minimum_bins(sorted(sizes, reverse=True), 12)
    assert lower_bound(a, 12) <= least <= len(fill) and (fill <= 12).all()
    assert len(fill) <= 11 * least / 9 + 1


def check_packed(rows, capacity=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@needs_data
def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_best_fit_packing(spark, SF).collect()
    n = check_packed(rows)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 2
    t, got = tokenizer(), {}
    for r in rows:
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
    want = {}
    for key, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for i in range(0, len(ids), 2048):
            part = ids[i:i + 2048]
            want[key, i // 2048] = (i, len(part), zlib.crc32(part.tobytes()))
    assert got == want


def test_several_parts_come_close_to_one(spark):
    draw = np.random.default_rng(3)
    rows = [(int(i), int(x)) for i, x in enumerate(draw.integers(1, 2049, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, length long")
    packed = pack(df, part=1000).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted(rows)
    alone = len(best_fit_decreasing(np.array([x for _, x in rows]), 2048)[2])
    assert lower_bound(np.array([x for _, x in rows]), 2048) <= check_packed(packed) <= alone * 1.01 + 1


def test_awkward_rows(spark):
    docs = awkward_docs(spark).selectExpr("*", "'x' as sequence_id", "'y' as length", "1 as piece")
    packed = pack(tokenized_pieces(docs, with_ids=True)).collect()
    check_packed(packed)
    assert sum(r.piece == 0 for r in packed) == docs.count()
    one = {r.doc_id: r for r in packed if r.doc_id in (3, 4, 5)}
    assert all(r.length == 1 and r.ids == [0] for r in one.values())
    assert pack(tokenized_pieces(docs.limit(0))).count() == 0
    clash = spark.createDataFrame([(1, 5, "s", "o")], "part long, length long, sequence_id string, bin string")
    assert pack(clash).collect()[0].part == 1


def test_a_deal_that_saves_nothing_is_not_taken(spark, monkeypatch):
    real, calls = packing.pack_task, []

    def first_well_then_badly(capacity, names):
        calls.append(1)
        good, bad = real(capacity, names), len(calls) > 1

        def task(table):
            out = good(table)
            if not bad:
                return out
            n, at = out.num_rows, out.column_names.index
            for name, value in (("bin", np.arange(n)), ("offset", np.zeros(n, dtype=np.int64)), ("bins", np.full(n, n))):
                out = out.set_column(at(name), name, [value])
            return out

        return task

    monkeypatch.setattr(packing, "pack_task", first_well_then_badly)
    draw = np.random.default_rng(3)
    rows = [(int(i), int(x)) for i, x in enumerate(draw.integers(1, 2049, 3000))]
    packed = pack(spark.createDataFrame(rows, "doc_id long, length long"), part=1000).collect()
    assert len(calls) == 2 and sorted((r.doc_id, r.length) for r in packed) == sorted(rows)
    alone = len(best_fit_decreasing(np.array([x for _, x in rows]), 2048)[2])
    assert check_packed(packed) <= alone * 1.01 + 3
