"""Operator 5, token counts: trie-shared dynamic programming over pre-tokens.

A pre-token is a word with a space mark in front. Its tokens are those of the segmentation into
vocabulary pieces of the highest total log probability (a unigram model; the public vocabulary
has ranks only, so a piece's probability is taken as falling with its rank by Zipf's law). The
best score of a prefix depends on the prefix alone: distinct pre-tokens are put into a trie and
each node's forward score and number of tokens are computed once, however many words share it.
Where a word ends, the node's number is its count. A worker keeps trie and counts from batch to
batch, up to a bound. A word longer than LONG has no nodes: its scores are computed in a window of
the longest piece.

Defined results. Text NULL, empty or without words: no pre-tokens, no tokens. Words are maximal
runs of characters other than 0x20 and 0x09-0x0D, of any length. A character without a piece
stands for as many byte tokens as it has UTF-8 bytes. Equal scores: fewer tokens. Repeated rows
are counted each. An empty table gives an empty table. Columns other than key and text play no
part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import Memo, arrow_column, tokenizer_path, worker_cache
from panelyard.llm.piece_model import NORMAL, SPACE, USER, read_model
from panelyard.llm.registry import query

VOCABULARY = "piece_bpe_32k.model"
BYTE_SCORE = -20.0       # of each byte of a character without a piece
NODES = 1_000_000        # of a worker's trie; then it starts anew
LONG = 100_000           # characters of a word that goes without nodes
WORD_MEMO = 500_000      # words whose counts a worker remembers
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def unigram_scores(data: bytes) -> dict[str, float]:
    """Piece -> log probability by rank."""
    model = read_model(data)
    pieces = [p for p, kind in zip(model.pieces, model.kinds) if kind in (NORMAL, USER) and p]
    total = math.log(sum(1.0 / (rank + 2.7) for rank in range(len(pieces))))
    return {p: -math.log(rank + 2.7) - total for rank, p in enumerate(pieces)}


class PieceTrie:
    """Forward scores of all prefixes of the words put in."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.scores, self.bound, self.longest = scores, nodes, max(map(len, scores), default=1)
        # Lengths of pieces by their last two characters: what can end at a position.
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        self.ends = {tail: tuple(sorted(sizes)) for tail, sizes in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def windowed(self, word: str) -> int:
        """The same for a word too long for the trie: only the last scores that a piece can reach
        back to are held."""
        scores, ends, width = self.scores, self.ends, self.longest + 1
        best, count = [0.0] * width, [0] * width
        for d, char in enumerate(word, 1):
            before = (d - 1) % width
            if char in scores:
                top, number = best[before] + scores[char], count[before] + 1
            else:
                size = len(char.encode("utf-8", "surrogatepass"))
                top, number = best[before] + size * BYTE_SCORE, count[before] + size
            if d > 1:
                for size in ends.get(word[d - 2:d], ()):
                    if size > d:
                        break
                    score = scores.get(word[d - size:d])
                    if score is not None:
                        at = (d - size) % width
                        total = best[at] + score
                        if total > top or (total == top and count[at] + 1 < number):
                            top, number = total, count[at] + 1
            best[d % width], count[d % width] = top, number
        return count[len(word) % width]

    def add(self, word: str) -> int:
        """Put a word in; the number of tokens of its best segmentation."""
        if len(word) > LONG:
            return self.windowed(word)
        if len(self.best) + len(word) > self.bound and len(self.best) > 1:
            self.clear()
        child, best, count, scores, ends = self.child, self.best, self.count, self.scores, self.ends
        path, node = [0], 0
        for d, char in enumerate(word, 1):
            step = (node, char)
            following = child.get(step)
            if following is None:
                top, number = -math.inf, 0
                if char in scores:
                    top, number = best[node] + scores[char], count[node] + 1
                else:
                    size = len(char.encode("utf-8", "surrogatepass"))
                    top, number = best[node] + size * BYTE_SCORE, count[node] + size
                if d > 1:
                    for size in ends.get(word[d - 2:d], ()):
                        if size > d:
                            break
                        score = scores.get(word[d - size:d])
                        if score is not None:
                            before = path[d - size]
                            total = best[before] + score
                            if total > top or (total == top and count[before] + 1 < number):
                                top, number = total, count[before] + 1
                following = len(best)
                child[step] = following
                best.append(top)
                count.append(number)
            path.append(following)
            node = following
        return count[node]


def counter(path: str) -> Memo:
    def make():
        with open(path, "rb") as f:
            trie = PieceTrie(unigram_scores(f.read()))
        return Memo(WORD_MEMO, lambda words: [trie.add(SPACE + w) for w in words])

    return worker_cache("token_counts", "piece_counter_" + path, make)


def count_column(text: str | Column, vocabulary: str | None = None) -> Column:
    """A struct of n_pretokens and n_tokens."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def kernel():
        memo = counter(path)

        def run(texts):
            words = [_WORDS.findall(t) if t else [] for t in texts]
            memo.prepare(set().union(*words))
            return [len(w) for w in words], [sum(map(memo.__getitem__, w)) for w in words]

        return run

    return arrow_column(kernel, "n_pretokens long, n_tokens long", text)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_pretokens, n_tokens) of each document. One narrow pass."""
    made = docs.select(F.col(f"`{key}`").alias("k"), count_column(F.col(f"`{text}`").cast("string"), vocabulary).alias("c"))
    return made.select(F.col("k").alias(key), "c.n_pretokens", "c.n_tokens")


@query()
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
