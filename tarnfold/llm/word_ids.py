"""Whole-text encoding with a tokenizers file, memoised by white-space-delimited chunk.

The tokenizer of ``word_bpe_49k.json`` normalises (NFC, white space to one space, lower case) and then
splits with a pattern of which no match holds white space; white space itself is dropped. None of the
steps looks across white space, so a text's ids are the concatenated ids of its chunks. The library
encodes every distinct chunk; a memo repeats its answer. ``chunk_safe`` checks that a tokenizer file
has this shape; for any other, whole texts go to the library.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

from .piece_codec import byte_characters
from .shared import LONG, Memo

# str.split() also cuts at these four, which the tokenizer's pattern does not count as white space.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
# ASCII marks but the apostrophe, which can begin a pre-token of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def chunk_safe(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": "\\s+"}
        and steps[1].get("content") == " "
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and spec.get("post_processor") is None
    )


class WordIds:
    """Encodes texts to little-endian unsigned 32-bit ids. Strings of special tokens are ordinary text.

    A chunk that is a run of letters below U+0250, perhaps with ASCII marks behind, goes straight to the
    library's BPE model: such letters are in normal form, their lower case is letter by letter, and the
    run is one pre-token. Every other chunk goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_chunk = chunk_safe(path)
        self.model = self.tokenizer.model
        self.map = dict(enumerate(byte_characters()))
        self.known = Memo(self.chunk)
        self.tails: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.letters(chunk) or self.library(chunk)
        stem = chunk.rstrip(_MARKS)
        if not stem.isalpha():
            return self.library(chunk)
        ids = self.known.get(stem)
        if ids is None and (ids := self.letters(stem)) is None:
            return self.library(chunk)
        tail = chunk[len(stem) :]
        if tail not in self.tails:
            if len(tail) > LONG:
                return ids + self.library(tail)
            if len(self.tails) > 10_000:
                self.tails = {}
            self.tails[tail] = self.library(tail)
        return ids + self.tails[tail]

    def letters(self, run: str) -> bytes | None:
        low = run.lower()
        if low != run:
            if (ids := self.known.get(low)) is not None:
                return ids
            run = low
        if not run.isascii():
            if max(run) > "\u024f":
                return None
            run = run.encode("utf-8").decode("latin-1").translate(self.map)
        return array("I", [t.id for t in self.model.tokenize(run)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for t in texts:
            if not t:
                out.append(b"")
            elif not self.by_chunk or any(c in t for c in _NOT_SPACE):
                out.append(self.library(t))
            else:
                chunks, parts = t.split(), []
                for at in range(0, len(chunks), 50_000):  # a very long text may fill a generation on its own
                    self.known = self.known.trimmed()
                    parts += map(self.known.__getitem__, chunks[at : at + 50_000])
                out.append(b"".join(parts))
        return out


_SHARED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a worker process and file, kept from task to task."""
    if path not in _SHARED:
        _SHARED[path] = WordIds(path)
    return _SHARED[path]
