"""Encoding of texts with a public byte-level BPE vocabulary through a sentencepiece model
that is serialised straight from the vocabulary (problem 6)."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 400_000  # pre-tokens that a worker remembers; a full memory starts again
#: Fixed value: the public pre-token pattern of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """One printable letter for each byte: printable Latin-1 stands for itself, the rest in
    order follows from U+0100."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    at = {b: chr(b) for b in own}
    for b in range(256):
        if b not in at:
            at[b] = chr(256 + len(at) - len(own))
    return [at[b] for b in range(256)]


LETTERS = byte_letters()
_MAP = {b: LETTERS[b] for b in range(256)}
_BACK = {c: b for b, c in enumerate(LETTERS)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        low, n = n & 127, n >> 7
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes by length, int as varint, float as fixed32."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(vocabulary: bytes) -> bytes:
    """The vocabulary (lines of base64 bytes and rank) as a sentencepiece BPE ModelProto:
    piece 0 is <unk>, piece rank + 1 is the byte-mapped entry scored -rank; identity
    normalisation, no dummy prefix, no white-space rules."""
    ranks = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, vocabulary.splitlines()))
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for r, token in ranks:
        pieces.append(_field(1, _field(1, "".join(map(_MAP.__getitem__, token)).encode()) + _field(2, float(-r)) + _field(3, 1)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """encode(text) -> ids by the public vocabulary; decode(ids) -> text. Strings that look
    like special tokens are ordinary text; null and empty texts have no ids."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def _piece(self, word: str) -> list[int]:
        mapped = "".join(map(_MAP.__getitem__, word.encode()))
        ids = [i - 1 for i in self.sp.encode(mapped)]
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        get, add = self.known.get, out.extend
        for w in self.split(text):
            add(get(w) or self._piece(w))
        return out

    def decode(self, ids: list[int]) -> str:
        mapped = "".join(self.sp.id_to_piece([int(i) + 1 for i in ids])) if len(ids) else ""
        return bytes(_BACK[c] for c in mapped).decode("utf-8", "replace")


def _model(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(sentencepiece_model(f.read()))


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row: whole texts, nulls and empty texts as an empty list,
    one output row per input row (repeated rows too). The vocabulary is read on the driver
    and broadcast (a file of fixed size)."""
    model = _model(df, vocabulary)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for b in batches:
            lists = [np.asarray(encoder.encode(t), np.int32) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def sizes(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens BIGINT) of every row, without moving the ids; 0 for null and empty."""
    model = _model(df, vocabulary)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for b in batches:
            n = [len(encoder.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [key, "n_tokens"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
