"""Operator 6, quality rules: repetition within a text by suffix arrays.

Words of many texts lie in one array, each text with symbols of its own. The suffixes are
sorted by prefix doubling (only suffixes still tied go on), and the common prefixes of
neighbours follow from the ranks kept at each doubling. A run of neighbours whose common
prefix is at least m words long is an interval of the longest-common-prefix array: the
suffixes in it start with one repeated substring. The longest one a suffix takes part in is
the larger of its two neighbour prefixes, so the union of all maximal repeats' spans is the
union of ``[p, p + longest(p))`` over the positions p.

Defined results. Text NULL, empty or without a word: no words, all figures 0, ``base_failed``
(too short), no spans. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
Overlapping occurrences count (``a a a`` repeats ``a a``). Equal rows get equal results; row
order has no influence. An empty table gives an empty table. Columns of the input called like
those added are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import arrow_column, sliced
from panelyard.llm.registry import query

WINDOW = 5                # words of a repeated window of the base figures
MIN_WORDS = 10            # base: fewer words fail
BASE_PERCENT = 20         # base: more words in repeated windows fail
REPEAT_WORDS = 12         # a repeat of the method's own rule has at least so many words
COVERED = 0.15            # of the words may lie in such repeats
LONGEST_SHARE = 0.10      # of the words may be one single repeat ...
LONGEST_WORDS = 60        # ... unless it is no longer than this
BATCH_WORDS = 400_000     # words sorted at once; a longer text is sorted alone

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, covered_words long, base_failed boolean, kept boolean"
)
SPANS = ", repeat_spans array<struct<start:long,end:long>>"
_SPACE = b" \t\n\r\x0b\x0c"
_INSIDE = bytes(range(0x80, 0xC0))   # bytes of a code point after its first
_SYMBOLS = b"#*$%&|<>"


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there and occurs
    elsewhere too. Symbols are non-negative; a text's symbols occur in no other text."""
    n = len(symbols)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    _, rank = np.unique(symbols, return_inverse=True)
    levels, width = [], 1
    order = np.argsort(rank, kind="stable")
    while True:
        levels.append(rank)
        sizes = np.bincount(rank)
        tied = np.flatnonzero(sizes[rank] > 1)
        if not len(tied):
            break
        # Ranks count from 1 here, so that 0 stands for the end of the array.
        after = np.zeros(len(tied), dtype=np.int64)
        inside = tied + width < n
        after[inside] = rank[tied[inside] + width] + 1
        key = rank[tied].astype(np.int64) * (n + 2) + after
        by_key = np.argsort(key, kind="stable")
        moved, key = tied[by_key], key[by_key]
        first = np.r_[True, key[1:] != key[:-1]]
        # Within a rank's places, each new key takes the place of its first suffix.
        group_start = np.r_[0, np.cumsum(sizes)[:-1]]
        old = rank[moved]
        new_group = np.r_[True, old[1:] != old[:-1]]
        index = np.arange(len(moved))
        in_group = index - np.maximum.accumulate(np.where(new_group, index, 0))
        place = group_start[old] + in_group
        order[place] = moved
        # A dense rank: old ranks plus the splits made before them.
        splits = np.zeros(len(sizes), dtype=np.int64)
        np.add.at(splits, old[first & ~new_group], 1)
        shift = np.r_[0, np.cumsum(splits)[:-1]]
        fresh = rank + shift[rank]
        run = np.cumsum(first) - 1
        base = np.maximum.accumulate(np.where(new_group, run, 0))
        fresh[moved] = old + shift[old] + (run - base)
        if fresh.max() == rank.max():
            # No tie was broken: what is tied now never splits, as equal suffixes do not exist.
            rank = fresh
            width *= 2
            if width > n:
                break
            continue
        rank = fresh
        width *= 2
    # Common prefix of neighbours in the suffix array: the binary digits of its length.
    left, right = order[:-1], order[1:]
    alive = np.flatnonzero(levels[0][left] == levels[0][right])
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step, ranks = 1 << level, levels[level]
        a, b = left[alive] + common[alive], right[alive] + common[alive]
        inside = (a + step <= n) & (b + step <= n)
        same = np.zeros(len(alive), dtype=bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        common[alive[same]] += step
    best[order[:-1]] = common
    best[order[1:]] = np.maximum(best[order[1:]], common)
    return best


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """True at positions inside some repeat of at least ``least`` symbols."""
    starts = np.flatnonzero(longest >= least)
    edges = np.zeros(len(longest) + 1, dtype=np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + longest[starts], 1)
    return np.cumsum(edges[:-1]) > 0


def text_figures(texts: list[str | None], least: int) -> tuple:
    """Figures of each text, and the flags of covered words with the texts' bounds."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [b.split() for b in data]   # bytes split at exactly 0x20 and 0x09-0x0D
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    chars = [len(b.translate(None, _SPACE + _INSIDE)) for b in data]
    marks = [len(b) - len(b.translate(None, _SYMBOLS)) for b in data]
    dup_lines = []
    for b in data:
        lines = [line for line in b.split(b"\n") if line.strip(_SPACE)]
        dup_lines.append(len(lines) - len(set(lines)))
    longest = np.zeros(bounds[-1], dtype=np.int64)
    for lo, hi in sliced(words, sizes, BATCH_WORDS):
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        total = int(bounds[hi] - bounds[lo])
        ids = np.fromiter((i for w in words[lo:hi] for i in map(number.__getitem__, w)), dtype=np.int64, count=total)
        ids += np.repeat(np.arange(hi - lo), sizes[lo:hi]) * (len(number) + 1)
        longest[bounds[lo]:bounds[hi]] = longest_repeats(ids)

    def per_text(values: np.ndarray) -> np.ndarray:
        running = np.r_[0, np.cumsum(values)]
        return running[bounds[1:]] - running[bounds[:-1]]

    repeat = per_text(covered(longest, WINDOW))
    flags = covered(longest, least)
    most = np.zeros(len(texts), dtype=np.int64)
    full = sizes > 0
    if full.any():
        most[full] = np.maximum.reduceat(longest, bounds[:-1][full])
    return sizes, chars, marks, dup_lines, repeat, most, per_text(flags), flags, bounds


def span_array(flags: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of true flags within each text, as (start, end) in words of the text."""
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(flags & (edge[:-1] | ~np.r_[False, flags[:-1]]))
    end = np.flatnonzero(flags & (edge[1:] | ~np.r_[flags[1:], False])) + 1
    text = np.searchsorted(bounds, start, side="right") - 1
    offsets = np.searchsorted(start, bounds)
    pairs = pa.StructArray.from_arrays(
        [pa.array(start - bounds[text], pa.int64()), pa.array(end - bounds[text], pa.int64())], names=["start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def rules_column(
    text: str | Column = "text",
    least: int = REPEAT_WORDS,
    max_covered: float = COVERED,
    longest_share: float = LONGEST_SHARE,
    longest_words: int = LONGEST_WORDS,
    spans: bool = True,
) -> Column:
    """A struct of FIELDS (and ``repeat_spans`` in words, unless ``spans`` is false)."""

    def kernel():
        def run(texts):
            sizes, chars, marks, dup_lines, repeat, most, cover, flags, bounds = text_figures(texts, least)
            failed = (sizes < MIN_WORDS) | (100 * repeat > BASE_PERCENT * sizes)
            too_long = (most > longest_words) & (most > longest_share * sizes)
            kept = ~failed & (cover <= max_covered * sizes) & ~too_long
            out = [sizes, chars, marks, dup_lines, repeat, most, cover, failed, kept]
            return out + [span_array(flags, bounds)] if spans else out

        return run

    return arrow_column(kernel, FIELDS + (SPANS if spans else ""), text)


def repetition_rules(docs: DataFrame, text: str = "text", spans: bool = True, **limits) -> DataFrame:
    """``docs`` with the fields of ``rules_column``. A row is kept if the base rules pass, at
    most ``max_covered`` of its words lie in repeats of ``least`` words or more, and no repeat is
    longer than both ``longest_words`` and ``longest_share`` of the text. One narrow pass."""
    names = [f.strip().split(" ")[0] for f in FIELDS.split(", ")] + (["repeat_spans"] if spans else [])
    rest = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("#text"))
    made = source.withColumn("#rules", rules_column("#text", spans=spans, **limits))
    return made.select(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`#rules`.{n}").alias(n) for n in names])


@query()
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition_rules(docs, spans=False).drop("text")
