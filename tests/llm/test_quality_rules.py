"""Repetition rules against brute force."""

import re
from collections import Counter

import numpy as np
from llm_helpers import SF, awkward_docs, needs_data
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm.quality_rules import (
    COVERED, LONGEST_SHARE, LONGEST_WORDS, REPEAT_WORDS, covered, longest_repeats, op6_quality_rules, repetition_rules,
)


def brute_longest(s):
    n, out = len(s), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and s[i + k] == s[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_longest_repeats(s):
    longest = longest_repeats(np.array(s, dtype=np.int64))
    assert longest.tolist() == brute_longest(s)
    flags = covered(longest, 3)
    spans = {p for i, k in enumerate(longest) if k >= 3 for p in range(i, i + k)}
    assert set(np.flatnonzero(flags)) == spans


def brute_base(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i:i + 5]) for i in range(len(found) - 4))
    inside = {p for i in range(len(found) - 4) if windows[tuple(found[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(found)
    return (n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def brute_kept(text):
    """The verdict from sets of windows: a word lies in a long repeat if a window of REPEAT_WORDS
    over it is found twice, and the longest repeat is the largest width with an equal pair."""
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(found)

    def repeated(width):
        windows = Counter(tuple(found[i:i + width]) for i in range(n - width + 1))
        return [i for i in range(n - width + 1) if windows[tuple(found[i:i + width])] > 1]

    words = {p for i in repeated(REPEAT_WORDS) for p in range(i, i + REPEAT_WORDS)}
    low, high = 0, n   # some width low repeats, none of width high does
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if repeated(middle) else (low, middle)
    too_long = low > LONGEST_WORDS and low > LONGEST_SHARE * n
    return low, len(words), not brute_base(text)[-1] and len(words) <= COVERED * n and not too_long


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@needs_data
def test_query_base_figures(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op6_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in BASE) == brute_base(texts[r.doc_id])
        assert (r.longest_repeat, r.covered_words, r.kept) == brute_kept(texts[r.doc_id])


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = repetition_rules(docs.selectExpr("*", "1 as kept", "2 as n_words")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[c] for c in BASE) == brute_base(r.text)
        assert (r.longest_repeat, r.covered_words, r.kept) == brute_kept(r.text)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].kept and by_id[1].kept and not by_id[10].kept and not by_id[3].kept
    assert by_id[3].repeat_spans == [] and [(s.start, s.end) for s in by_id[10].repeat_spans] == [(0, 50)]
    assert repetition_rules(docs.limit(0)).count() == 0


def test_long_repeat_is_rejected_and_its_span_given(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    text = " ".join(f"a{i}" for i in range(700)) + " " + passage + " " + " ".join(f"b{i}" for i in range(20)) + " " + passage
    text += " " + " ".join(f"c{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, " ".join(f"a{i}" for i in range(500)))], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition_rules(docs, longest_share=0.05).collect()}
    assert got[1].longest_repeat == 80 and not got[1].base_failed and not got[1].kept and got[2].kept
    assert [(s.start, s.end) for s in got[1].repeat_spans] == [(700, 780), (800, 880)]
