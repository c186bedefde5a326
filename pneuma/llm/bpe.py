"""Byte-level BPE through a sentencepiece model written straight from the rank file.

Every byte is mapped to one printable character, every vocabulary entry becomes a
piece of mapped characters with score -rank, and normalisation is the identity.
sentencepiece's BPE joins the best-scored neighbours first, leftmost on a tie, which is
the merge order of the rank file. Each match of the pre-tokenisation pattern is encoded
on its own; decoding maps the pieces back to bytes.

Null text counts as empty (no ids, empty decoded bytes). Repeated rows each get a row.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import batches_by_bytes, ship
from .units import TextEncoder

RANKS_FILE = "byte_bpe_50k.tiktoken"
OUT_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, round_trip boolean"


def byte_chars() -> list[str]:
    """One printable character per byte: the byte itself where printable in Latin-1, else from U+0100 on."""
    keep = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    kept = set(keep)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append((n & 0x7F) | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece ModelProto; piece id i is the i-th vocabulary entry by rank, the last is unknown."""
    chars = byte_chars()
    order = sorted(ranks.items(), key=lambda x: x[1])
    pieces = []
    for token, rank in order:
        body = _field(1, "".join(chars[b] for b in token).encode()) + b"\x15" + struct.pack("<f", -float(rank))
        pieces.append(_field(1, body + _number(3, 1)))
    unk = _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)
    minus_one = (1 << 64) - 1
    trainer = (_number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order)) + _number(41, minus_one)
               + _number(42, minus_one) + _number(43, minus_one))
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(1, unk) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encode and decode with one vocabulary; built once per Python worker."""

    _built: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of_piece = [r for _, r in order]
        self.identity = self.rank_of_piece == list(range(len(order)))
        self.token_of = {r: t for t, r in order}
        self.chars = dict(enumerate(byte_chars()))
        width = max(self.token_of, default=0) + 1
        lens = np.zeros(width, dtype=np.int64)
        for r, t in self.token_of.items():
            lens[r] = len(t)
        self.lens = lens
        self.starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if width else lens
        self.bytes = np.frombuffer(b"".join(self.token_of.get(r, b"") for r in range(width)), dtype=np.uint8)
        self.texts = TextEncoder(pattern, self._encode_word)

    @classmethod
    def get(cls, path: str, pattern: str) -> "Codec":
        key = (path, pattern)
        if key not in cls._built:
            cls._built[key] = cls(load_ranks(path), pattern)
        return cls._built[key]

    def _merge(self, word: bytes) -> list[int]:
        ids = self.sp.encode(word.decode("latin-1").translate(self.chars), num_threads=1)
        return ids if self.identity else [self.rank_of_piece[i] for i in ids]

    def _encode_word(self, word: str) -> bytes:
        return array("I", self._merge(word.encode())).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.texts(texts)

    def decode(self, ids) -> bytes:
        """Bytes of an array of ids, by the inverse mapping."""
        import numpy as np
        lens = self.lens[ids]
        total = int(lens.sum())
        if not total:
            return b""
        out_start = np.cumsum(lens) - lens
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - out_start, lens)].tobytes()


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text and decode the ids again; one row per input row, no shuffle.

    ``round_trip`` tells whether the decoded bytes equal the text's UTF-8 bytes.
    """
    ship(docs.sparkSession)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        codec = Codec.get(ranks_path, pattern)
        for batch in batches_by_bytes(it, "text", 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = codec.encode(texts)
            decoded = [codec.decode(np.frombuffer(x, dtype="<u4")) for x in ids]
            yield pa.record_batch([
                batch.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                pa.array([len(x) for x in decoded], pa.int64()),
                pa.array([x == t.encode() for x, t in zip(decoded, texts)], pa.bool_()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "round_trip"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, OUT_SCHEMA)


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids as an array column, for users who want the tokens themselves."""
    ship(docs.sparkSession)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        codec = Codec.get(ranks_path, pattern)
        for batch in batches_by_bytes(it, "text", 4 << 20):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32)
                   for x in codec.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        run, "doc_id long, ids array<int>")
