"""Operator 9, SentencePiece encoding and decoding with offsets.

Text is normalised by longest prefixes of the model's compiled character map; each normalised
byte keeps the source position it came from. Segments between space marks are encoded by the
library, each distinct one once for as long as a worker remembers it, and every piece's extent in
the normalised text is projected through the alignment to a span of source bytes. Decoding is the
library's own.

Defined results. Text NULL counts as empty: only the end id. Spans are [begin, end) in UTF-8 bytes
of the source; the added space in front and pieces of one character's bytes but the last have
empty spans, the last one has the character. Very long texts count whole. Repeated rows are
encoded each. An empty table gives an empty table. Columns other than key and text play no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import Memo, arrow_column, tokenizer_path, worker_cache
from panelyard.llm.piece_model import BYTE, SPACE, UNKNOWN, PieceModel, read_model
from panelyard.llm.registry import query

VOCABULARY = "piece_bpe_32k.model"
SEGMENT_MEMO = 500_000   # segments a worker remembers
_MARK = SPACE.encode()
_SEGMENTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class CharacterMap:
    """A compiled map of byte strings: a double-array trie and the strings its leaves name."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if blob else []
        self.texts = blob[4 + size:]
        self.memo: dict[int, bytes] = {}

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry that starts at ``at``."""
        if not self.units:
            return None
        units, found = self.units, None
        node = 0
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        value, length = found
        if value not in self.memo:
            self.memo[value] = self.texts[value:self.texts.index(b"\0", value)]
        return self.memo[value], length


class Normaliser:
    def __init__(self, model: PieceModel):
        self.model, self.map = model, CharacterMap(model.charsmap)
        self.space = _MARK if model.escape_spaces else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) its source position."""
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        if self.map.units or self.model.remove_extra_spaces or self.model.space_as_suffix:
            return self.by_prefixes(data)
        return self.by_array(data)

    def by_array(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """A map without entries: only spaces change."""
        source = np.frombuffer(data, dtype=np.uint8)
        place = np.arange(len(source))
        start = np.maximum.accumulate(np.where((source & 0xC0) != 0x80, place, 0))
        width = np.where(source == 32, len(self.space), 1)
        align = np.repeat(start, width)
        prefix = self.space if self.model.dummy_prefix else b""
        out = prefix + data.replace(b" ", self.space)
        return out, np.r_[np.zeros(len(prefix), dtype=np.int64), align, len(data)]

    def by_prefixes(self, data: bytes) -> tuple[bytes, np.ndarray]:
        model, out, align = self.model, bytearray(), []
        at, end = 0, len(data)

        def prefix(i: int) -> tuple[bytes, int]:
            hit = self.map.longest(data, i)
            if hit is not None:
                return hit
            size = 1
            while i + size < end and data[i + size] & 0xC0 == 0x80:
                size += 1
            return data[i:i + size], size

        if model.remove_extra_spaces:
            while at < end:
                text, size = prefix(at)
                if text != b" ":
                    break
                at += size
            if at == end:
                return b"", np.zeros(1, dtype=np.int64)
        if model.dummy_prefix and not model.space_as_suffix:
            out += self.space
            align += [at] * len(self.space)
        after_space = model.remove_extra_spaces
        while at < end:
            text, size = prefix(at)
            while after_space and text[:1] == b" ":
                text = text[1:]
            for byte in text:
                add = self.space if byte == 32 else bytes([byte])
                out += add
                align += [at] * len(add)
            if text:
                after_space = model.remove_extra_spaces and text[-1:] == b" "
            at += size
        if model.remove_extra_spaces:
            while out.endswith(self.space):
                at = align[len(out) - len(self.space)]
                del out[len(out) - len(self.space):], align[len(out):]
        if model.dummy_prefix and model.space_as_suffix:
            out += self.space
            align += [at] * len(self.space)
        return bytes(out), np.array(align + [at], dtype=np.int64)


class Encoder:
    """Ids and source spans of texts."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        model = read_model(data)
        self.normalise = Normaliser(model)
        self.whole = SentencePieceProcessor(model_proto=data)
        self.core = SentencePieceProcessor(model_proto=model.core)
        self.end = self.whole.eos_id()
        self.split = model.splits_at_spaces
        self.unknown = np.array([i for i, kind in enumerate(model.kinds) if kind == UNKNOWN])
        self.name = [str(i).encode() for i in range(len(model.pieces))]
        self.length = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in zip(model.pieces, model.kinds)], dtype=np.int32)
        self.memo = Memo(SEGMENT_MEMO, self.segments)

    def segments(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each segment: its ids as text and as numbers."""
        found = self.core.encode(texts, num_threads=1)
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        edges = (4 * np.r_[0, np.cumsum([len(ids) for ids in found])]).tolist()
        data, name = flat.tobytes(), self.name.__getitem__
        return [(b" ".join(map(name, ids)), data[a:b]) for ids, a, b in zip(found, edges[:-1], edges[1:])]

    def sizes(self, words: list[str], ids: np.ndarray) -> np.ndarray:
        """Bytes of normalised text of each piece."""
        if not np.isin(ids, self.unknown).any():
            return self.length[ids]
        # A piece that stands for unknown text has no length of its own.
        out = []
        for word in words:
            own = np.frombuffer(self.memo[word][1], dtype=np.int32)
            if np.isin(own, self.unknown).any():
                out += [len(p.surface.encode()) for p in self.core.encode(word, return_type="proto").pieces]
            else:
                out += self.length[own].tolist()
        return np.array(out, dtype=np.int32)

    def __call__(self, texts: list[str | None]):
        """For each text: (ids as text, ids, begins, ends), the end id included."""
        sources = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        normal = [self.normalise(s) for s in sources]
        words = []
        for text, _ in normal:
            text = text.decode("utf-8", "surrogatepass")
            words.append(_SEGMENTS.findall(text) if self.split else [text] if text else [])
        self.memo.prepare(set().union(*words))
        look, last, ending = self.memo.__getitem__, self.name[self.end], np.array([self.end], dtype=np.int32)
        for source, (_, align), own in zip(sources, normal, words):
            if not own:
                yield last, ending, np.array([len(source)]), np.array([len(source)])
                continue
            names, numbers = zip(*map(look, own))
            ids = np.frombuffer(b"".join(numbers), dtype=np.int32)
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum(self.sizes(own, ids), out=edge[1:])
            at = np.append(align[edge], len(source))
            begins, ends = np.append(at[:-2], len(source)), at[1:]
            yield b" ".join(names) + b" " + last, np.append(ids, ending), begins, ends


def encoder(path: str) -> Encoder:
    def make():
        with open(path, "rb") as f:
            return Encoder(f.read())

    return worker_cache("piece_encoding", "piece_encoder_" + path, make)


ENCODED = "ids array<int>, begins array<int>, ends array<int>"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"


def encoded_column(text: str | Column, vocabulary: str | None = None) -> Column:
    """A struct of ENCODED: the pieces' ids and source spans."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def kernel():
        encode = encoder(path)

        def run(texts):
            made = list(encode(texts))
            return tuple([m[i] for m in made] for i in (1, 2, 3))

        return run

    return arrow_column(kernel, ENCODED, text)


def decoded_column(ids: str | Column, vocabulary: str | None = None) -> Column:
    """Text of an array of ids; NULL stays NULL."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def kernel():
        whole = encoder(path).whole

        def run(rows):
            return ([None if r is None else whole.decode(list(r)) for r in rows],)

        return run

    return arrow_column(kernel, "text string", ids)["text"]


def digest_column(text: str | Column, vocabulary: str | None = None) -> Column:
    """A struct of DIGEST, from the same encoding without moving its arrays out of the task.
    ``covered_bytes``: source bytes that lie in some piece's span."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def kernel():
        encode = encoder(path)

        def run(texts):
            number, ids_sha, text_sha, covered = [], [], [], []
            for named, ids, begins, ends in encode(texts):
                number.append(len(ids))
                ids_sha.append(hashlib.sha256(named).hexdigest())
                decoded = encode.whole.decode(ids.tolist())
                text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                covered.append(int((ends - begins).sum()))
            return tuple(pa.array(c) for c in (number, ids_sha, text_sha, covered)) if number else ([], [], [], [])

        return run

    return arrow_column(kernel, DIGEST, text)


@query()
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", digest_column("text").alias("d")).select("doc_id", "d.*")
