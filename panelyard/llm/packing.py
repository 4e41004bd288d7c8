"""Operator 1, best-fit packing: bound-certified repacking.

Pieces of at most ``capacity`` tokens go into as few sequences as possible. Full pieces fill one
each. The others are dealt to parts at random; each part runs best-fit decreasing and computes
lower bounds on its number of bins by dual feasible functions (Martello-Toth rounding and
rounding down of multiples). A bin that is full is closed. Of a part whose bins meet its bound
only the last, least filled bin can be improved by others; a part above its bound gives all its
bins with gaps. The documents of those bins go into a new, smaller deal and are packed again,
until a deal saves no bin (then the placement before it stays), one part holds all that is left,
or ROUNDS deals were made; what is then left to the lower bounds is logged. A part that was
certified and alone cannot be improved.

Defined results. A document's length is its number of ids, at least one; text NULL counts as
empty. Pieces are cut from the start, the last one may be shorter. Rows with equal ids, or
wholly equal rows, are packed each for itself. Within a sequence offsets run without a gap from
0. Sequence numbers are unique and otherwise have no meaning; they may differ between runs.
An empty table gives an empty table. Columns other than key and text play no part.
"""

from __future__ import annotations

import logging
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import Memo, arrow_column, parts_for, spread, stored, tokenizer_path, worker_cache
from panelyard.llm.registry import query

CAPACITY = 2048
END_ID = 0
PART = 65_536            # pieces packed by one task
ROUNDS = 12
WORD_MEMO = 500_000      # words whose ids a worker remembers
VOCABULARY = "word_bpe_49k.json"

# The vocabulary's own splitting rule (fixed values), over characters below 0x180. There, but
# for the ones left out below, lower-casing, white space and the classes of letters and numbers
# are the same here as in the tokenizer library. Texts with other characters go to it whole.
_LOW = [chr(c) for c in range(0x180) if c not in (0x130, 0x149)]
_LETTERS = "".join(c for c in _LOW if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _LOW if unicodedata.category(c)[0] == "N")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e" + "".join(re.escape(c) for c in _LOW if ord(c) > 0xA0 and c != "\xad") + "]*")


def plain(text: str) -> bool:
    return bool(_PLAIN.fullmatch(text)) and "<|" not in text and unicodedata.is_normalized("NFC", text)


def library_ids(tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def word_ids(tokenizer):
    """(words -> ids of each as little-endian bytes): all words in one call, told apart by the
    mark of a word's end in their last token."""
    size = tokenizer.get_vocab_size()
    last = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def many(words: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(words), 4096):
            part = words[lo:lo + 4096]
            ids = library_ids(tokenizer, " ".join(part))
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(part):
                data, ends = ids.tobytes(), (4 * ends).tolist()
                out += [data[a:b] for a, b in zip([0, *ends], ends)]
            else:
                out += [library_ids(tokenizer, word).tobytes() for word in part]
        return out

    return many


def texts_ids(texts: list[str | None], tokenizer, memo: Memo) -> list[bytes]:
    """Ids of each text without special ones, as bytes. Words of plain texts are looked up one
    by one, as the tokenizer never merges across them."""
    words = [_WORDS.findall(t.lower()) if t and plain(t) else None for t in texts]
    memo.prepare(set().union(*(w for w in words if w)))
    look = memo.__getitem__
    return [
        b"".join(map(look, w)) if w is not None else library_ids(tokenizer, t).tobytes() if t else b""
        for t, w in zip(texts, words)
    ]


def token_pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    """Kernel: text -> its pieces (start, length, crc32 of the ids, the ids if wanted)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def kernel():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = worker_cache("packing", "tokenizer_" + path, lambda: Tokenizer.from_file(path))
        memo = worker_cache("packing", "word_ids_" + path, lambda: Memo(WORD_MEMO, word_ids(tokenizer)))
        step = 4 * capacity

        def run(texts):
            counts, start, length, crc, ids = [0], [], [], [], []
            for data in texts_ids(texts, tokenizer, memo):
                data += end
                for at in range(0, len(data), step):
                    piece = data[at:at + step]
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int64))
                counts.append(len(start))
            columns = [pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            return (pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(columns, names=names)),)

        return run

    return kernel


def tokenized_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document: key, piece, start, length, ids_crc32 (and ids)."""
    kernel = token_pieces(vocabulary or tokenizer_path(VOCABULARY), capacity, end_id, with_ids)
    ids = ", ids:array<long>" if with_ids else ""
    kind = f"pieces array<struct<start:long,length:long,ids_crc32:long{ids}>>"
    made = docs.select(F.col(f"`{key}`").alias("k"), arrow_column(kernel, kind, F.col(f"`{text}`").cast("string")).alias("m"))
    rows = made.select("k", F.posexplode("m.pieces").alias("piece", "p"))
    return rows.select(F.col("k").alias(key), "piece", "p.*")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins any packing of ``sizes`` needs: the best of several dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int(sizes.sum()) // capacity)
    # Rounding by a threshold e: sizes above capacity - e count as full, those below e as nothing.
    weight = np.cumsum(count * size)
    number = np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        above = number[capacity] - number[capacity - e]
        between = weight[capacity - e] - weight[e - 1]
        best = max(best, int(above) - (-int(between) // capacity))
    # Rounding down to multiples of 1/k, exact multiples of 1/(k+1) staying as they are.
    present = np.flatnonzero(count)
    for k in range(1, 65):
        scaled = (k + 1) * present
        value = np.where(scaled % capacity == 0, present * k, (scaled // capacity) * capacity)   # times capacity * k
        best = max(best, -(-int((value * count[present]).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the fill of each bin. Bins wait by their gap; a bit mask
    of the gaps that occur finds the smallest one that fits."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = waiting[gap].pop()
            if not waiting[gap]:
                mask ^= 1 << gap
        else:
            b, gap = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        left = gap - size
        if left:
            if not waiting[left]:
                mask |= 1 << left
            waiting[left].append(b)
    return bins, offsets, np.array(fill, dtype=np.int64)


def open_bins(fill: np.ndarray, bound: int, capacity: int) -> np.ndarray:
    """Bins whose documents another part could use: of a certified part the least filled one,
    of others every bin with a gap."""
    out = np.zeros(len(fill), dtype=bool)
    if len(fill) > bound:
        out[:] = fill < capacity
    elif len(fill):
        least = int(fill.argmin())
        out[least] = fill[least] < capacity
    return out


PLACED = "bin long, offset long, fill long, bins long, bound long, open boolean"


def pack_task(capacity: int, names: list[str]):
    def task(table: pa.Table) -> pa.Table:
        bins, offsets, fill = best_fit_decreasing(table.column("length").to_numpy().astype(np.int64), capacity)
        bound = lower_bound(table.column("length").to_numpy().astype(np.int64), capacity)
        n = len(bins)
        added = {
            "bin": bins, "offset": offsets, "fill": fill[bins], "bins": np.full(n, len(fill)), "bound": np.full(n, bound),
            "open": open_bins(fill, bound, capacity)[bins],
        }
        return pa.table({**{c: table.column(c) for c in names}, **added})

    return task


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (columns so called are replaced).

    Lengths are from 1 to ``capacity``; others raise. Rounds after the first move only the
    documents of open bins: few for each part.
    """
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    named = {c: f"c{i}" for i, c in enumerate(keep)}
    rows = stored(pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.col(f"`{length}`").cast("long").alias("length")))
    figures = rows.agg(
        F.count("*").alias("n"), F.count(F.when(F.col("length").between(1, capacity), 1)).alias("good"),
        F.count(F.when(F.col("length") < capacity, 1)).alias("short"),
    ).first()
    if figures["n"] != figures["good"]:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    names = list(named.values())
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + f", length long, {PLACED}"
    full = rows.filter(F.col("length") == capacity).select(
        *names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    closed, pool, n, before = [full], rows.filter(F.col("length") < capacity), figures["short"], None
    for round_ in range(ROUNDS):
        if not n:
            break
        parts = parts_for(n, part)
        # Sequence numbers: round, part and bin, each with room to spare.
        dealt = pool.select(*names, "length").withColumn("part", spread(parts, "length"))
        work = pack_task(capacity, [*names, "length"])
        placed = stored(dealt.groupBy("part").applyInArrow(with_part(work), schema + ", part long"))
        sequence = F.lit(round_ << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
        done = placed.withColumn("sequence_id", sequence).select(*names, "length", "offset", "sequence_id", "open")
        state = placed.select("part", "bins", "bound").distinct().agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound")).first()
        if before is not None and state["bins"] >= before["bins"]:
            # The deal saved nothing: its documents stay where they were.
            closed.append(pool.select(*names, "sequence_id", "offset"))
            gap = before["bins"] - -(-before["tokens"] // capacity)
            logging.getLogger(__name__).info("packing: deal %d saved no bin; at most %d above the lower bound", round_, gap)
            break
        left = placed.filter("open").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"), F.countDistinct("part", "bin").alias("bins")).first()
        # The open bins can shrink to their tokens' share at best.
        alone = parts == 1 and (state["bins"] == state["bound"] or round_ > 0)
        hopeless = left["n"] == 0 or left["bins"] <= -(-left["tokens"] // capacity)
        if alone or hopeless or round_ == ROUNDS - 1:
            closed.append(done.select(*names, "sequence_id", "offset"))
            gap = state["bins"] - state["bound"]
            logging.getLogger(__name__).info("packing: closed after deal %d, bins above the parts' lower bounds: %d", round_, gap)
            break
        closed.append(done.filter("not open").select(*names, "sequence_id", "offset"))
        pool, n, before = done.filter("open"), left["n"], left
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], "sequence_id", "offset")


def with_part(task):
    """The task's table with the number of its part."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = task(table)
        return out.append_column("part", pa.array([key[0].as_py()] * out.num_rows, pa.int64()))

    return run


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(tokenized_pieces(docs))
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
