"""Token ids of whole texts, encoded word by word.

The tokenizer drops white space and never forms a token across it, so a text's ids are its words' ids in a row.
Each worker keeps the ids of words it has met; only new words go through the ``tokenizers`` library. The result equals
encoding the whole text, whatever the memory holds.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sightline.llm.base import portions

WORDS_KEPT = 400_000  # per worker; beyond that, words are encoded anew, which costs time and changes nothing
BYTES_AT_ONCE = 4 << 20
END_ID = 1
# Fixed value: the tokenizer's pattern, for lower-case ASCII.
PRE_TOKENS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+")

_encoders: dict[str, WordEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.letters = self.tokenizer.model, self.tokenizer.normalizer, byte_letters()
        self.known: dict[bytes, bytes] = {}

    def fresh(self, word: bytes) -> bytes:
        """The ids of one word.

        Plain ASCII falls into pre-tokens by the tokenizer's own pattern, and a word of Latin letters is one pre-token;
        they go to the model at once, and pre-tokens are remembered like words. Everything else goes the whole way.
        """
        if word.isalpha():
            low = word.lower()
            return self.pieces(low.decode()) if low == word else self.word(low)
        if word.isascii() and b"<|" not in word and min(word) > 32 and max(word) < 127:
            parts = PRE_TOKENS.findall(word.lower())
            return b"".join(map(self.word, parts)) if len(parts) > 1 else self.pieces(parts[0].decode())
        text = word.decode()
        if text.isalpha() and max(text) < "\u0250":
            text = self.normalizer.normalize_str(text)
            if text.isalpha():
                return self.pieces(text.encode().decode("latin-1").translate(self.letters))
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces(self, token: str) -> bytes:
        return packed([piece.id for piece in self.model.tokenize(token)])

    def word(self, word: bytes) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.fresh(word) if word else b""
            if len(self.known) < WORDS_KEPT:
                self.known[word] = ids
        return ids

    def ids(self, text: bytes | None) -> bytes:
        """The ids of a text; null counts as empty."""
        return b"".join(map(self.word, (text or b"").split()))

    def encoded(self, texts: pa.Array) -> Iterator[Encoded]:
        """The ids of many texts, in portions: different words are looked up once, and columns do the rest."""
        texts = texts.fill_null("")
        for some in portions(pc.binary_length(texts).to_pylist(), BYTES_AT_ONCE):
            lists = pc.ascii_split_whitespace(texts[some])
            held = lists.flatten().dictionary_encode()
            words = held.dictionary.cast(pa.binary()).to_pylist()
            ids = list(map(self.known.get, words))
            for i, (word, of_word) in enumerate(zip(words, ids)):
                if of_word is None:
                    ids[i] = self.word(word)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            starts = np.cumsum(sizes) - sizes
            place = held.indices.to_numpy(zero_copy_only=False)
            counts = sizes[place]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            order = np.arange(total) + np.repeat(starts[place] - (ends - counts), counts)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            yield Encoded(some, np.frombuffer(b"".join(ids), dtype="<u4")[order], counts, bounds, np.r_[0, ends][bounds])


@dataclass
class Encoded:
    """A portion of texts: all ids in a row, ids per word, and each text's bounds among words and ids.

    White space at a text's ends may count as an empty word, which has no id.
    """

    texts: slice
    ids: np.ndarray
    word_ids: np.ndarray
    word_bounds: np.ndarray
    bounds: np.ndarray

    def each(self) -> Iterator[bytes]:
        """The ids of each text as bytes."""
        for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            yield self.ids[a:b].tobytes()


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def with_end(ids: bytes) -> bytes:
    return ids + END_ID.to_bytes(4, "little")
