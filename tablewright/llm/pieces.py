"""Reading the vocabulary of a SentencePiece model file."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

#: Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"

#: Where the public model lies unless the caller names another.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: A model file larger than this is refused: it travels to every worker.
MODEL_LIMIT = 64 << 20


@dataclass
class Vocabulary:
    """Pieces that text may be cut into, with scores, and the ids of the byte pieces."""

    ids: dict[str, int] = field(default_factory=dict)
    scores: list[float] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    byte_ids: dict[int, int] = field(default_factory=dict)


def read_model(path: str = MODEL_PATH) -> bytes:
    """The file's bytes, read on the driver; workers get them with the task."""
    if os.path.getsize(path) > MODEL_LIMIT:
        raise ValueError(f"{path} is larger than {MODEL_LIMIT} bytes")
    with open(path, "rb") as f:
        return f.read()


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, wire type, value) of a protobuf message, one level deep."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if wire == 5 else 8
            value, at = data[at : at + size], at + size
        yield number, wire, value


def parse_model(data: bytes) -> Vocabulary:
    """Normal and user-defined pieces become cuttable; control and unknown pieces never come out of text."""
    vocabulary = Vocabulary()
    for number, wire, value in fields(data):
        if number != 1 or wire != 2:
            continue
        text, score, kind = "", 0.0, NORMAL
        for n, _, v in fields(value):
            if n == 1:
                text = v.decode("utf-8")
            elif n == 2:
                score = struct.unpack("<f", v)[0]
            elif n == 3:
                kind = v
        at = len(vocabulary.pieces)
        vocabulary.pieces.append(text)
        vocabulary.scores.append(score)
        if kind in (NORMAL, USER):
            vocabulary.ids[text] = at
        elif kind == BYTE:
            vocabulary.byte_ids[int(text[3:5], 16)] = at
    return vocabulary
