"""Reading a sentencepiece model file: the few protobuf fields that encoding needs."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Where the public tokenizers lie; a parameter of every operator that reads one.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            n, i = _varint(data, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


@dataclass
class PieceModel:
    """Pieces, their scores and kinds by id, and the normaliser's switches."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    charsmap: bytes = b""

    @classmethod
    def load(cls, path: str = TOKENIZER) -> PieceModel:
        m = cls()
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                got = dict(_fields(value))
                m.pieces.append(got[1].decode())
                m.scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
                m.kinds.append(got.get(3, NORMAL))
            elif number == 2:
                got = dict(_fields(value))
                m.bpe, m.byte_fallback = got.get(3, 1) == 2, bool(got.get(35, 0))
            elif number == 3:
                got = dict(_fields(value))
                m.charsmap = got.get(2, b"")
                m.dummy_prefix, m.squeeze, m.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))
        return m
