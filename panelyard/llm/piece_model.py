"""What a SentencePiece model file holds, read by its public format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6   # kinds of pieces (fixed values)
SPACE = "▁"


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """(field, wire type, value, raw bytes) of a protocol buffer message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            size, at = _number(data, at)
            value, at = data[at:at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError("not a model file")
        yield tag >> 3, kind, value, data[start:at]


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    space_as_suffix: bool = False
    core: bytes = b""   # the same model with the plainest normalizer: its input is normalised text

    @property
    def splits_at_spaces(self) -> bool:
        """Whether no piece has a space mark after another character, so that text falls into
        independent segments that begin with space marks."""
        return not any(SPACE in p.lstrip(SPACE) for p, kind in zip(self.pieces, self.kinds) if kind in (NORMAL, USER))


def read_model(data: bytes) -> PieceModel:
    model, rest = PieceModel(), []
    for number, _, value, raw in fields(data):
        if number == 1:
            part = {n: v for n, _, v, _ in fields(value)}
            model.pieces.append(part[1].decode())
            model.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            model.kinds.append(part.get(3, NORMAL))
        elif number == 2:
            for n, _, v, _ in fields(value):
                if n == 24:
                    model.space_as_suffix = bool(v)
        elif number == 3:
            for n, _, v, _ in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
            continue
        rest.append(raw)
    plain = b"\x0a\x08identity\x18\x00\x20\x00"   # name; no dummy prefix; keep spaces
    model.core = b"".join(rest) + b"\x1a" + bytes([len(plain)]) + plain
    return model
