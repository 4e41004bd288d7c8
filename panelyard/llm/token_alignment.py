"""Operator 13, cross-tokenizer alignment with an identity map as fast path.

Tokenizer A is byte-level, B has pieces with a space mark and adds a space in front, so both cut
the bytes of a space and the text. Where tokens of both end, a group ends; every pair of an A and
a B token whose byte ranges overlap is a link. Ends of both, merged, make elementary ranges, and
each is exactly one link.

1. Neither tokenizer has a token across the start of a word (one space between a character that
   is none and one that is no white space; checked for B's vocabulary), so a task encodes and
   aligns each different word once, many words one after the other on one axis of bytes.
2. Identity map: for every A id the B id of the same bytes. A group of one such pair is counted in
   a vector with a cell per A id. Only groups of other kinds give pairs (a, b); a task adds its
   own pairs up, and those sums are what the shuffle moves.
3. Counts of identical pairs (a cell per A id), the highest count of each B id, and the counts of
   the HOT most frequent other pairs have a fixed bound and go out with the second pass, which
   scores every document. What rare pairs a document has left is joined to the counts by pair and
   added up by document; a frequent pair never enters that join.

Defined results. Text NULL or empty, or whose joined A or B bytes differ from the space and the
text (a U+2581 in it, for instance): no tokens, zeros, an empty digest, no part in any count. Names
of special tokens in a text are plain text. Very long texts count whole, also without a space.
Repeated rows are counted and returned each. Several B ids of the same bytes: the map has the
lowest that is no single-byte one if there is any; a group with another of them is not identical.
An empty table gives an empty table. Columns other than key and text play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import arrow_column, stored, text_batches, text_slices, tokenizer_path, worker_cache
from panelyard.llm.piece_model import BYTE, SPACE, read_model
from panelyard.llm.registry import query

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
HOT = 1 << 18            # most frequent pairs that go out with the second pass
WORD_MEMO = 400_000      # words a worker remembers in the second pass
TASK_TEXT = 24_000_000   # characters of text whose words a task of the first pass gathers
TASK_WORDS = 400_000     # different words among them
TASK_PAIRS = 2_000_000   # pair sums a task holds before it hands them on
MANY = 16_384            # words aligned at once
TOGETHER = 256           # words encoded as one text
# How byte-level vocabularies split text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STARTS = re.compile(r"(?<=[^ ])(?= \S)")
_ODD = re.compile(r"  | \s")


def words_of(text: str) -> list[str]:
    """The space and the text, cut where words start; each word without its first space."""
    if " " not in (text[0], text[-1]) and not text[0].isspace() and not _ODD.search(text):
        return text.split(" ")
    return [word[1:] for word in _STARTS.split(" " + text)]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def rank_encoder(spec: dict):
    """The same byte-level encoding by a quicker library, or None where that is not certain: the
    i-th merge must make the i-th id after the bytes, and the usual splitting rule be in force."""
    merges, vocabulary = spec["model"]["merges"], spec["model"]["vocab"]
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    made = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges)
    if not plain or spec["model"].get("type", "BPE") != "BPE" or any(vocabulary.get(m) != 256 + i for i, m in enumerate(made)):
        return None
    from tiktoken import Encoding

    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in name): i for name, i in vocabulary.items() if i < 256 + len(merges)}
    return Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligned:
    """Tokens, groups and links of some words, one after the other, by the bytes where they end."""

    def __init__(self, own: Aligner, a: np.ndarray, b: np.ndarray, sizes: list[int]):
        self.a, self.b, self.word_end = a, b, np.cumsum(sizes)
        self.a_end, self.b_end = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
        mark = np.zeros(int(self.word_end[-1]) + 1 if sizes else 1, dtype=np.int8)
        mark[self.a_end] = 1
        mark[self.b_end] += 2
        # Each range between neighbouring ends is one link, of the tokens that end there or later.
        self.link_end = np.flatnonzero(mark)
        mark = mark[self.link_end]
        ends_a, ends_b, closes = (mark & 1).astype(np.int64), (mark >> 1).astype(np.int64), mark == 3
        last_a, last_b = np.cumsum(ends_a), np.cumsum(ends_b)
        self.link_a, self.link_b = a[last_a - ends_a], b[last_b - ends_b]
        self.group_end = self.link_end[closes]
        self.last_a, self.last_b = last_a[closes], last_b[closes]   # tokens up to each group's end
        self.single = (np.diff(self.last_a, prepend=0) == 1) & (np.diff(self.last_b, prepend=0) == 1)
        self.same = self.single[np.cumsum(closes) - closes] & (own.same[self.link_a] == self.link_b)

    def cuts(self, ends: np.ndarray) -> np.ndarray:
        """Where each word's items begin, and the end."""
        return np.r_[0, np.searchsorted(ends, self.word_end, side="right")]

    def texts(self, known: dict[int, str]) -> list[str]:
        """Each word's groups. ``known``: text of groups of one A and one B token."""
        first_a, first_b = np.r_[0, self.last_a[:-1]], np.r_[0, self.last_b[:-1]]
        keys = np.where(self.single, pack(self.a[first_a], self.b[first_b]), -1 - np.arange(len(first_a)))
        keys = keys.tolist()
        known.update((k, f"{k >> 32}|{k & 0xFFFFFFFF}") for k in set(keys).difference(known) if k >= 0)
        out = list(map(known.get, keys))
        many = np.flatnonzero(~self.single)
        if len(many):
            a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
            edges = (x[many].tolist() for x in (first_a, self.last_a, first_b, self.last_b))
            for i, a_lo, a_hi, b_lo, b_hi in zip(many.tolist(), *edges):
                out[i] = ",".join(a[a_lo:a_hi]) + "|" + ",".join(b[b_lo:b_hi])
        cut = self.cuts(self.group_end).tolist()
        return [";".join(out[i:j]) for i, j in zip(cut[:-1], cut[1:])]


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path)
        a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            quick = rank_encoder(json.load(f))
        self.a_whole = quick is not None   # its tokens are the text's bytes, whatever the text
        self.a_ids = quick or (lambda text: a.encode(text, add_special_tokens=False).ids)
        with open(b_path, "rb") as f:
            model = read_model(f.read())
        if not model.splits_at_spaces or not model.dummy_prefix or model.remove_extra_spaces or model.charsmap:
            raise ValueError("B must add a space, keep text as it is and have no piece across a word's start")
        self.b = SentencePieceProcessor(model_proto=model.core)
        alphabet = byte_alphabet()
        names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, kind in zip(model.pieces, model.kinds)
        ]
        self.a_size = np.array([len(b) for b in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(b) for b in self.b_bytes], dtype=np.int64)
        same = {}
        for i in sorted(range(len(self.b_bytes)), key=lambda i: (model.kinds[i] == BYTE, i)):
            same.setdefault(self.b_bytes[i], i)
        self.same = np.array([same.get(b, -1) for b in self.a_bytes], dtype=np.int64)

    def tokens(self, words: list[str]) -> tuple[list[int], list[int], bool]:
        """Ids of the words, each with its space, by both; whether their bytes are the words'."""
        text = " " + " ".join(words)
        a, b = self.a_ids(text), self.b.encode(text.replace(" ", SPACE), num_threads=1)
        data = text.encode("utf-8", "surrogatepass")
        if not self.a_whole and b"".join(map(self.a_bytes.__getitem__, a)) != data:
            return a, b, False
        return a, b, b"".join(map(self.b_bytes.__getitem__, b)) == data

    def align(self, words: list[str]) -> tuple[Aligned, list[str], list[str]]:
        """The words aligned, in the order of the second result; the third are those left out as
        their tokens' bytes are others."""
        # Only a text's first word may begin with white space and its last end with a space:
        # next to such a word others would not stand as in their texts.
        alone = [w for w in words if not w or w[0].isspace() or w[-1] == " "]
        if alone:
            apart = set(alone)
            words = [w for w in words if w not in apart]
        all_a, all_b, good, bad = [], [], [], []
        for part in chain((words[lo:lo + TOGETHER] for lo in range(0, len(words), TOGETHER)), ([w] for w in alone)):
            a, b, right = self.tokens(part)
            if right:
                all_a.append(a)
                all_b.append(b)
                good += part
                continue
            for w in part:
                a, b, right = self.tokens([w])
                if right:
                    all_a.append(a)
                    all_b.append(b)
                (good if right else bad).append(w)
        flat = [np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (all_a, all_b)]
        return Aligned(self, *flat, [1 + (len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass"))) for w in good]), good, bad


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for a pair of ids."""
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


def aligner(a_path: str, b_path: str) -> Aligner:
    return worker_cache("token_alignment", f"aligner {a_path} {b_path}", lambda: Aligner(a_path, b_path))


def added(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their sums."""
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    return pairs[starts], np.add.reduceat(n, starts) if len(starts) else n


def count_task(a_path: str, b_path: str):
    """Link counts of a task's documents: identical ones by a vector, others as pair sums. Texts
    are gathered up to a bound, so that a word is aligned once for all of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        vector = np.zeros(len(own.same), dtype=np.int64)
        held, texts, times, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], Counter(), 0

        def rows(pairs, n, same):
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n), pa.array(np.full(len(pairs), same))], ["pair", "n", "same"])

        def add(times: Counter, sign: int) -> set[str]:
            nonlocal held
            words, more, every_bad = list(times), [held], set()
            for lo in range(0, len(words), MANY):
                found, part, bad = own.align(words[lo:lo + MANY])
                every_bad.update(bad)
                n = sign * np.fromiter(map(times.__getitem__, part), dtype=np.int64, count=len(part))
                n = np.repeat(n, np.diff(found.cuts(found.link_end)))
                np.add.at(vector, found.link_a[found.same], n[found.same])
                more.append(added(pack(found.link_a, found.link_b)[~found.same], n[~found.same]))
            held = added(*(np.concatenate(c) for c in zip(*more)))
            return every_bad

        def count():
            nonlocal held
            bad = add(times, 1)
            if bad:   # texts with such a word have no tokens: the others are taken off again
                split = (words_of(t) for t in texts)
                add(Counter(w for own_words in split if not bad.isdisjoint(own_words) for w in own_words if w not in bad), -1)
                held = tuple(c[held[1] != 0] for c in held)

        for batch in batches:
            column = batch.column(0)
            for lo, hi in text_slices([column]):
                part = [t for t in column.slice(lo, hi - lo).to_pylist() if t]
                for t in part:
                    times.update(words_of(t))
                texts += part
                size += sum(map(len, part))
                if size > TASK_TEXT or len(times) > TASK_WORDS:
                    count()
                    texts, times, size = [], Counter(), 0
                    if len(held[0]) > TASK_PAIRS:
                        yield rows(*held, False)
                        held = (held[0][:0], held[1][:0])
        if times:
            count()
        used = np.flatnonzero(vector)
        yield rows(pack(used, own.same[used]), vector[used], True)
        yield rows(*held, False)

    return task


def pair_counts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, same): links of each id pair over all rows of the only column. ``same``: pairs
    of the identity map, at most one for each A id."""
    made = texts.mapInArrow(count_task(a_path, b_path), "pair long, n long, same boolean")
    return stored(made.groupBy("pair").agg(F.sum("n").alias("n"), F.max("same").alias("same")))


SCORES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<pair:long,k:int>>"


class Scores:
    """Figures of each word under given counts, remembered up to a bound."""

    def __init__(self, own: Aligner, vector: np.ndarray, top: np.ndarray, hot: np.ndarray, hot_n: np.ndarray):
        self.own, self.vector, self.top, self.hot, self.hot_n = own, vector, top, hot, hot_n
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.numbers, self.texts, self.rest = np.zeros((0, 6), dtype=np.int64), [], []
        self.groups: dict[int, str] = {}   # at most a text for each pair met

    def prepare(self, wanted: set) -> None:
        if len(self.texts) > WORD_MEMO:
            self.clear()
        new = [w for w in wanted if w not in self.place]
        for lo in range(0, len(new), MANY):
            made = self.add(new[lo:lo + MANY])
            end = len(self.texts)
            if end > len(self.numbers):
                self.numbers = np.concatenate([self.numbers, np.zeros((max(end, MANY), 6), dtype=np.int64)])
            self.numbers[end - len(made):end] = made

    def add(self, words: list[str]) -> np.ndarray:
        found, words, bad = self.own.align(words)
        self.place.update(dict.fromkeys(bad, -1))
        if not words:
            return np.zeros((0, 6), dtype=np.int64)
        self.place.update(zip(words, range(len(self.texts), len(self.texts) + len(words))))
        pairs, n, known = pack(found.link_a, found.link_b), self.vector[found.link_a], found.same.copy()
        other = np.flatnonzero(~found.same)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, pairs[other]), len(self.hot) - 1)
            known[other] = self.hot[at] == pairs[other]
            n[other] = self.hot_n[at]
        n = np.where(known, n, 0)
        best = known & (n == self.top[found.link_b])
        cut = found.cuts(found.link_end)
        starts = cut[:-1]
        self.texts += found.texts(self.groups)
        rare = np.where(known, 0, 1)
        rest = [b""] * len(words)
        for i in np.flatnonzero(np.add.reduceat(rare, starts)).tolist() if rare.any() else ():
            links = slice(cut[i], cut[i + 1])
            rest[i] = pairs[links][~known[links]].tobytes()
        self.rest += rest
        sizes = [np.diff(found.cuts(e)) for e in (found.a_end, found.b_end, found.group_end)]
        return np.stack([*sizes, np.diff(cut), np.add.reduceat(best.astype(np.int64), starts), np.add.reduceat(n, starts)], axis=1)


def score_kernel(a_path: str, b_path: str, vector: np.ndarray, top: np.ndarray, hot: np.ndarray, hot_n: np.ndarray, with_groups: bool):
    """Kernel: text -> SCORES. ``vector``: counts of identical pairs by A id; ``top``: highest
    count by B id; ``hot`` and ``hot_n``: sorted frequent pairs and their counts."""
    call = uuid.uuid4().hex   # counts differ from call to call

    def kernel():
        kept = worker_cache("token_alignment", "scores", dict)
        if call not in kept:
            kept.clear()
            kept[call] = Scores(aligner(a_path, b_path), vector, top, hot, hot_n)
        scores = kept[call]

        def run(texts):
            digests, groups, cuts, rest_pairs, rest_k = [], [], [0], [], []
            words = [words_of(t) if t else [] for t in texts]
            scores.prepare(set().union(*words))
            table = np.zeros((len(texts), 6), dtype=np.int64)
            place, text_at, rest_at = scores.place.__getitem__, scores.texts.__getitem__, scores.rest.__getitem__
            for i, own_words in enumerate(words):
                at = list(map(place, own_words))
                numbers = np.array(at, dtype=np.int64)
                if not at or numbers.min() < 0:
                    digests.append("")
                    groups.append("")
                    cuts.append(cuts[-1])
                    continue
                table[i] = scores.numbers[numbers].sum(axis=0)
                text = ";".join(map(text_at, at))
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                groups.append(text if with_groups else None)
                rest = b"".join(map(rest_at, at))
                if rest:
                    pairs = np.frombuffer(rest, dtype=np.int64)
                    pairs, k = added(pairs, np.ones(len(pairs), dtype=np.int64))
                    rest_pairs.append(pairs)
                    rest_k.append(k)
                cuts.append(cuts[-1] + (len(pairs) if rest else 0))
            items = pa.StructArray.from_arrays([
                pa.array(np.concatenate(rest_pairs) if rest_pairs else np.zeros(0, np.int64)),
                pa.array((np.concatenate(rest_k) if rest_k else np.zeros(0, np.int64)).astype(np.int32)),
            ], names=["pair", "k"])
            columns = [pa.array(table[:, i]) for i in range(6)]
            made = [*columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items)]
            return [*made, pa.array(groups, pa.string())] if with_groups else made

        return run

    return kernel


def cross_align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", a_vocabulary: str | None = None, b_vocabulary: str | None = None,
    hot: int = HOT, with_groups: bool = False,
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, with
    ``with_groups`` also ``groups``: the ids of each group as text."""
    text_batches(docs.sparkSession)
    a_path, b_path = a_vocabulary or tokenizer_path(A_VOCABULARY), b_vocabulary or tokenizer_path(B_VOCABULARY)
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = pair_counts(rows.select("text"), a_path, b_path)
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    tops = stored(counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("top")))

    # All three have a fixed bound: a cell for each A id, one for each B id, ``hot`` pairs.
    own = Aligner(a_path, b_path)
    vector, top = np.zeros(len(own.same), dtype=np.int64), np.zeros(len(own.b_bytes), dtype=np.int64)
    same = counts.filter("same").select("pair", "n").toArrow()
    vector[same["pair"].to_numpy() >> 32] = same["n"].to_numpy()
    highest = tops.toArrow()
    top[highest["b"].to_numpy()] = highest["top"].to_numpy()
    frequent = counts.filter("not same").orderBy(F.desc("n"), "pair").limit(hot).select("pair", "n").toArrow()
    order = np.argsort(frequent["pair"].to_numpy(), kind="stable")
    kernel = score_kernel(a_path, b_path, vector, top, frequent["pair"].to_numpy()[order], frequent["n"].to_numpy()[order], with_groups)
    made = rows.select("id", arrow_column(kernel, SCORES + (", groups string" if with_groups else ""), "text").alias("s")).select("id", "s.*")
    made = stored(made.withColumn("row", F.monotonically_increasing_id()))

    left = made.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.pair", "r.k")
    rare = counts.join(tops, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    more = left.join(rare, "pair").groupBy("row").agg(
        F.sum(F.col("k") * F.col("n")).alias("sum_more"), F.sum(F.col("k") * F.col("best")).alias("best_more")
    )
    out = made.join(more, "row", "left")
    columns = ["n_a", "n_b", "n_groups", "n_links"]
    return out.select(
        F.col("id").alias(key), *columns, (F.col("n_best") + F.coalesce("best_more", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum_more", F.lit(0))).alias("count_sum"), "groups_sha256",
        *(["groups"] if with_groups else []),
    )


@query()
def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment figures of every document."""
    return cross_align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
