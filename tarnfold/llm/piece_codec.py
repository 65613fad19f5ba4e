"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Every byte maps to one printable character; a vocabulary entry becomes a piece of such characters with
score minus its rank, so that sentencepiece joins the same pairs in the same order. Normalisation is
the identity and no white space is touched. Texts are cut by the vocabulary's pattern first; each cut is
encoded alone, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import ENTRY, LONG


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece k is the entry of rank k; the unknown piece is last."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    pieces = [_field(1, _field(1, "".join(chars[b] for b in entry).encode()) + _field(2, float(-rank))) for entry, rank in by_rank]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(ranks)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class PieceCodec:
    """Encodes and decodes whole texts. Ids are the vocabulary's ranks; there are no special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.bytes_of = [b for b, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes(self.ranks))
        self.map = dict(enumerate(byte_characters()))
        self.known, self.before, self.held, self.limit = {}, {}, 0, 100_000_000

    def _learn(self, cuts: set[str]) -> None:
        """Adds cuts to the memo: from its last generation, else from the library, all in one call."""
        new = []
        for c in cuts:
            ids = self.before.get(c)
            if ids is None:
                new.append(c)
            else:
                self.known[c] = ids
        plain = [c.encode("utf-8").decode("latin-1").translate(self.map) for c in new]
        for c, ids in zip(new, self.model.encode(plain, num_threads=1), strict=True):
            if len(ids) > 1 and (rank := self.ranks.get(c.encode("utf-8"))) is not None:
                ids = (rank,)  # an entry that no sequence of joins reaches still stands for itself
            self.known[c] = array("i", ids).tobytes()
        self.held += sum(ENTRY + c.__sizeof__() + len(self.known[c]) for c in cuts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, some characters' worth of texts at a time."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= 1_000_000:
                out += self._encoded(group)
                group, size = [], 0
        return out + self._encoded(group)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Cuts that are new to the memo are encoded together; long ones are forgotten again."""
        all_cuts = [self.find(t) for t in texts]
        known, new = self.known.get, set()
        for cuts in all_cuts:
            found = list(map(known, cuts))
            if None in found:
                new.update(c for c, ids in zip(cuts, found, strict=True) if ids is None)
        if new and self.held > self.limit:  # a new generation: it needs the others of these texts as well
            self.known, self.before, self.held = {}, self.known, 0
            new = {c for cuts in all_cuts for c in cuts}
        if new:
            self._learn(new)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, cuts)), np.int32) for cuts in all_cuts]
        for c in [c for c in new if len(c) > LONG]:
            self.held -= ENTRY + c.__sizeof__() + len(self.known.pop(c))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_SHARED: dict[tuple[str, str], PieceCodec] = {}


def piece_codec(path: str, pattern: str) -> PieceCodec:
    """One codec a worker process, vocabulary and pattern, kept from task to task."""
    if (path, pattern) not in _SHARED:
        _SHARED[path, pattern] = PieceCodec(path, pattern)
    return _SHARED[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>, decoded binary`` of every row: its ids, and what they decode to.

    Null and empty texts have no ids and decode to nothing. Null keys and repeated rows stay as they
    are; an empty table gives no rows; other columns are ignored. One pass without a shuffle; a task
    keeps a memo of cuts bounded by bytes. Very long texts and cuts are encoded whole; cuts of over 200 characters are not remembered.
    """

    def run(batches):
        codec = piece_codec(vocabulary, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                ids = codec.encode([t or "" for t in texts[at : at + 256]])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(ids)), pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids)), pa.array([codec.decode(x) for x in ids], pa.binary())],
                    names=["k", "ids", "decoded"],
                )

    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(run, "k long, ids array<int>, decoded binary").withColumnRenamed("k", key)
