"""Token counts of pages that are edited: a segment tree per page, and only what an edit touches is encoded again.

The tokenizer forms no token across white space, so a text falls into pre-token regions that can be counted alone. A
leaf is a stretch of ``LEAF_WORDS`` words with the white space behind them; inner nodes hold the sums of characters
and tokens below. An edit finds its leaves from the top by characters, joins neighbours only where no white space
parts them (the boundary context), encodes that region, and renews the sums on the way up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import raw
from sightline.llm.words import WordEncoder, word_encoder

LEAF_WORDS = 16
LEAF = re.compile(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){1,%d}[\x20\x09-\x0D]*|[\x20\x09-\x0D]+" % LEAF_WORDS)
WHITES = tuple("\x20\x09\x0a\x0b\x0c\x0d")


def summed(leaves: np.ndarray) -> np.ndarray:
    """A complete binary tree over the leaves: node 1 is the root, node ``n + i`` leaf ``i``."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    tree = np.zeros(2 * size, dtype=np.int64)
    tree[size:size + len(leaves)] = leaves
    level = size
    while level > 1:
        tree[level // 2:level] = tree[level:2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return tree


def planted_forms(texts: pa.Array, encoder: WordEncoder) -> Iterator[tuple[int, bytes]]:
    """Tokens in all, and the stored form of the tree, of each text."""
    for portion in encoder.encoded(texts):
        filled = portion.word_ids > 0  # every word has an id, so what has none is white space at an end
        bounds = np.r_[0, np.cumsum(filled)][portion.word_bounds]
        counts = portion.word_ids[filled]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            leaves = np.add.reduceat(counts[a:b], np.arange(0, b - a, LEAF_WORDS)) if b > a else np.zeros(1, np.int64)
            tree = summed(leaves)
            yield int(tree[1]), np.r_[0, tree].astype("<i4").tobytes()


class PreTokenTree:
    """A page's leaves with sums of characters and tokens.

    Stored, a tree is little-endian 32-bit integers: how many leaf lengths follow, the lengths in characters, and the token sums. A tree
    that was never edited names no lengths, since its leaves are the text's own cut.
    """

    def __init__(self, leaves: list[str], tokens: np.ndarray) -> None:
        self.leaves, self.tokens = leaves, tokens
        self.chars = summed(np.array([len(leaf) for leaf in leaves], dtype=np.int64))
        self.encoded = self.edits = 0

    @classmethod
    def planted(cls, text: str, encoder: WordEncoder) -> PreTokenTree:
        return cls.stored(text, next(planted_forms(pa.array([text]), encoder))[1])

    @classmethod
    def stored(cls, text: str, form: bytes) -> PreTokenTree:
        held = np.frombuffer(form, dtype="<i4").astype(np.int64)
        named = int(held[0])
        if not named:
            return cls(LEAF.findall(text) or [""], held[1:])
        ends = np.cumsum(held[1:1 + named]).tolist()
        tree = cls([text[a:b] for a, b in zip([0, *ends], ends)], held[1 + named:])
        tree.edits = 1
        return tree

    def stored_form(self) -> bytes:
        lengths = [len(leaf) for leaf in self.leaves] if self.edits else []
        return np.r_[len(lengths), lengths, self.tokens].astype("<i4").tobytes()

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, place: int) -> tuple[int, int]:
        """Leaf and place inside it of a character; the end of the text belongs to its last leaf with characters."""
        place = min(place, int(self.chars[1]) - 1)
        node, size = 1, len(self.chars) // 2
        while node < size:
            node *= 2
            if place >= self.chars[node]:
                place -= int(self.chars[node])
                node += 1
        return node - size, place

    def replace(self, start: int, length: int, replacement: str, encoder: WordEncoder) -> None:
        """Put ``replacement`` for ``length`` characters from ``start``; both are held inside the text."""
        end_of_text = int(self.chars[1])
        start = min(max(start, 0), end_of_text)
        end = min(start + max(length, 0), end_of_text)
        self.edits += 1
        if not end_of_text:
            first = last = 0
            region = replacement
        else:
            first, at = self.find(start)
            at += start == end_of_text
            last, until = self.find(max(start, end - 1))
            until = until + 1 if end > start else at
            region = self.leaves[first][:at] + replacement + self.leaves[last][until:]
        # Without white space between them, what stands next to the region is part of its words. To the right first: where
        # nothing is left of the region, its two neighbours may now touch.
        while last + 1 < len(self.leaves) and region[-1:] not in WHITES:
            last += 1
            region = region + self.leaves[last]
            if self.leaves[last]:
                break
        while first > 0 and region and region[0] not in WHITES and self.leaves[first - 1][-1:] not in WHITES:
            first -= 1
            region = self.leaves[first] + region
        self._renew(first, last, region, encoder)

    def _renew(self, first: int, last: int, region: str, encoder: WordEncoder) -> None:
        """Cut the region into leaves anew and count them; a region with more leaves than it had makes room in a new tree."""
        parts = LEAF.findall(region)
        counts = [len(encoder.ids(part.encode())) // 4 for part in parts]
        self.encoded += len(region.split())
        room = last - first + 1
        size = len(self.tokens) // 2
        if len(parts) > room:
            leaf_tokens = np.r_[self.tokens[size:size + first], counts, self.tokens[size + last + 1:size + len(self.leaves)]]
            leaves = self.leaves[:first] + parts + self.leaves[last + 1:]
            full = [i for i, leaf in enumerate(leaves) if leaf]  # empty leaves go when a tree is built anyway
            self.leaves, self.tokens = [leaves[i] for i in full], summed(leaf_tokens[full])
            self.chars = summed(np.array([len(leaf) for leaf in self.leaves], dtype=np.int64))
            return
        self.leaves[first:last + 1] = parts + [""] * (room - len(parts))
        self.tokens[size + first:size + last + 1] = counts + [0] * (room - len(parts))
        self.chars[size + first:size + last + 1] = [len(leaf) for leaf in self.leaves[first:last + 1]]
        low, high = (size + first) // 2, (size + last) // 2
        while low:
            for tree in (self.tokens, self.chars):
                tree[low:high + 1] = tree[2 * low:2 * high + 2].reshape(-1, 2).sum(axis=1)
            low, high = low // 2, high // 2


def plant_trees(pages: DataFrame, vocabulary: str) -> DataFrame:
    """``(uri, content, n_tokens, tree BINARY)`` of ``pages(uri, content)``: counted once, to be kept and edited later.

    Null content is empty. Rows stand each for itself; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            totals, trees = zip(*planted_forms(batch.column(1), encoder)) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals, pa.int64()), pa.array(trees, pa.binary())], ["uri", "content", "n_tokens", "tree"])

    kind = pages.schema["uri"].dataType.simpleString()
    return pages.select("uri", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).mapInArrow(
        run, f"uri {kind}, content string, n_tokens bigint, tree binary")


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """Apply ``edits(uri, edit_ix, start, length, replacement)`` to ``trees(uri, content, n_tokens, tree)``.

    Returns ``(uri, content, tree, n_edits, n_tokens_before, n_tokens, n_words, n_words_encoded)`` for every row of
    ``trees``. Edits of a page apply in the order of ``edit_ix``; ``start`` and ``length`` count characters of the text as
    the edits before left it, and are held inside it (null start: 0, null length: 0, null replacement: nothing). A page's edits travel
    as one row, as its text does. Edits without ``uri`` or of pages that are not there are ignored; rows that
    repeat a ``uri`` are each edited; equal ``edit_ix`` apply by start, length and replacement. The returned ``content`` and
    ``tree`` can be edited again; an empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            done = []
            for text, before, tree, edits in zip(raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if not edits:
                    done.append((text, tree, 0, before, before, len(text.split()), 0))
                    continue
                held = PreTokenTree.stored(text.decode(), tree)
                for edit in edits:
                    held.replace(edit["start"] or 0, edit["length"] or 0, edit["replacement"] or "", encoder)
                text = held.text.encode()
                done.append((text, held.stored_form(), len(edits), before, held.total, len(text.split()), held.encoded))
            columns = list(zip(*done)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.binary()).cast(pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in columns[3:])],
                ["uri", "content", "tree", "n_edits", "n_tokens_before", "n_tokens", "n_words", "n_words_encoded"])

    lists = edits.where("uri IS NOT NULL").groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("edit_ix", "start", "length", "replacement"))).alias("edits"))
    kind = trees.schema["uri"].dataType.simpleString()
    return trees.select("uri", "content", "n_tokens", "tree").join(lists, "uri", "left").mapInArrow(
        run, f"uri {kind}, content string, tree binary, n_edits int, n_tokens_before bigint, n_tokens bigint, n_words bigint, n_words_encoded bigint")


# What a capture must not show.
NUMBER = r"[0-9][0-9 ().-]{5,}[0-9]"
ADDRESS = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"


def redactions(pages: DataFrame) -> DataFrame:
    """``edits(uri, edit_ix, start, length, replacement)`` that mask mail addresses and long numbers in ``pages(uri, content)``.

    The last one in a text comes first, so each place is still the original's.
    """
    address, number = re.compile(ADDRESS), re.compile(NUMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple[int, int, int, str]] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                spans = [(m.start(), m.end(), "[number]") for m in number.finditer(text or "")]
                spans += [(m.start(), m.end(), "[address]") for m in address.finditer(text or "")] if "@" in (text or "") else []
                last = 0
                clear = []
                for a, b, mask in sorted(spans):
                    if a >= last:
                        clear.append((a, b, mask))
                        last = b
                for n, (a, b, mask) in enumerate(reversed(clear)):
                    rows.append(i)
                    found.append((n, a, b - a, mask))
            if rows:
                n, start, length, mask = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(mask)],
                                                 ["uri", "edit_ix", "start", "length", "replacement"])

    kind = pages.schema["uri"].dataType.simpleString()
    return pages.select("uri", F.col("content").cast("string").alias("content")).mapInArrow(
        run, f"uri {kind}, edit_ix int, start bigint, length bigint, replacement string")
