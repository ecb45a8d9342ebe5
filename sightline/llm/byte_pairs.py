"""Token ids of fetched content under a byte-level pair vocabulary: proposed greedily, verified in columns, merged only where that fails.

A text falls into pre-tokens by the vocabulary's pattern; each different pre-token of a portion is encoded once. The longest
token that fits is taken from left to right, which is often what merging gives, but not always. A row of tokens is the
result of merging exactly if no two neighbours would have merged across their boundary on the way up, so every
different pair of neighbours is checked, all side by side: the parts that stand at the boundary are followed down both
derivations, and a merge that ranks before either part was used up rules the pair out. Pre-tokens with such a pair are
merged anew by rank.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import portions, raw
from sightline.llm.words import byte_letters

BYTES_AT_ONCE = 1 << 20
LONG_WORD = 256  # bytes; longer pre-tokens are matched at every place first, to the same result
WORDS_KEPT = 100_000  # merged pre-tokens a worker remembers; more cost time only
NEVER = np.int64(1 << 40)
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
# Endings that the vocabulary's pattern parts from a word, by length.
ENDINGS = (("s", "t", "m", "d"), ("re", "ve", "ll"))

_vocabularies: dict[str, PairVocabulary] = {}
_spellings: dict[str, list[bytes]] = {}


class PairVocabulary:
    """Tokens, merges and the trie of one vocabulary file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        spelled = lambda token: bytes(byte_of[c] for c in token)
        special = {t["content"].encode(): t["id"] for t in held["added_tokens"]}
        names = {spelled(token): number for token, number in held["model"]["vocab"].items() if token.encode() not in special}
        self.special, self.names = special, names
        size = 1 + max([*names.values(), *special.values()])
        self.spelling: list[bytes | None] = [None] * size
        for token, number in (names | special).items():
            self.spelling[number] = token
        self.sizes = np.array([len(t or b"") for t in self.spelling], dtype=np.int64)
        merges = [(spelled(a), spelled(b)) for a, b in (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])]
        left, right = (np.array([names[m[side]] for m in merges], dtype=np.int64) for side in (0, 1))
        made = np.array([names[a + b] for a, b in merges], dtype=np.int64)
        self.left, self.right, self.born = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made], self.born[made] = left, right, np.arange(len(made))
        if len(np.unique(made)) < len(made) or np.any(np.maximum(self.born[left], self.born[right]) >= np.arange(len(made))):
            raise ValueError("every token must come from one merge of earlier tokens")
        if any(bytes([b]) not in names for b in range(256)):
            raise ValueError("every byte must be a token")
        keys = left << 20 | right
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        self.ranks = dict(zip(keys.tolist(), range(len(merges))))
        self._grow_trie(self._sound(left, right, made))
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        self.kinds[0x20] = WHITE
        self.merged_words: dict[bytes, bytes] = {}

    def _sound(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which tokens come out whole when their own bytes are merged; only these are ever proposed."""
        fine = np.ones(len(self.sizes), dtype=bool)
        fine[made] = self.first_meeting(left, right) >= np.arange(len(made))
        for token, a, b in zip(made.tolist(), left.tolist(), right.tolist()):
            if not (fine[a] and fine[b]):
                fine[token] = False
        return fine

    def _grow_trie(self, fine: np.ndarray) -> None:
        edges: dict[int, int] = {}
        ends = [-1]
        for token, number in self.names.items():
            if not fine[number]:
                continue
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = number
        self.edges = np.array(sorted(edges), dtype=np.int64)
        self.child = np.array([edges[key] for key in self.edges.tolist()], dtype=np.int64)
        self.ends = np.array(ends, dtype=np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def first_meeting(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which tokens ``a`` and ``b``, side by side, first merge across their boundary; ``NEVER`` if they do not.

        Backwards in time: of the two parts at the boundary the one born later gives way to its own part there.
        The left part takes part only before it is used up; the right one also at that very rank, since merges go from the left.
        """
        found = np.full(len(a), NEVER)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_used, y_used = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            rank = self.pair_rank(x, y)
            meets = (rank < x_used) & (rank <= y_used) & (rank < NEVER)
            found[at[meets]] = rank[meets]  # ranks fall on the way, so the last one found is the first in time
            x_born, y_born = self.born[x], self.born[y]
            turn = x_born > y_born
            x_used, y_used = np.where(turn, x_born, x_used), np.where(turn, y_used, y_born)
            x, y = np.where(turn, self.right[x], x), np.where(turn, y, self.left[y])
            more = np.maximum(x_born, y_born) >= 0
            at, x, y, x_used, y_used = at[more], x[more], y[more], x_used[more], y_used[more]
        return found

    def longest(self, data: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place and ends by ``ends``."""
        best, node, alive, depth = np.full(len(places), -1, np.int64), np.zeros(len(places), np.int64), np.arange(len(places)), 0
        while True:
            alive = alive[places[alive] + depth < ends[alive]]
            if not len(alive):
                return best
            keys = node[alive] << 8 | data[places[alive] + depth]
            at = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            there = self.edges[at] == keys
            alive = alive[there]
            node[alive] = self.child[at[there]]
            token = self.ends[node[alive]]
            best[alive[token >= 0]] = token[token >= 0]
            depth += 1

    def proposed(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from left to right: the words' numbers and the tokens, word after word."""
        begins, ends = bounds[:-1], bounds[1:]
        whose, tokens = [], []
        for i in np.flatnonzero(ends - begins > LONG_WORD).tolist():
            matched = np.concatenate([self.longest(data, some := np.arange(a, min(a + BYTES_AT_ONCE, ends[i])), np.full(len(some), ends[i]))
                                      for a in range(begins[i], ends[i], BYTES_AT_ONCE)])
            steps, chain, at = self.sizes[matched].tolist(), [], 0
            while at < len(steps):
                chain.append(at)
                at += steps[at]
            whose.append(np.full(len(chain), i))
            tokens.append(matched[chain])
        words = np.flatnonzero((ends > begins) & (ends - begins <= LONG_WORD))
        places = begins[words]
        while len(words):
            matched = self.longest(data, places, ends[words])
            whose.append(words)
            tokens.append(matched)
            places = places + self.sizes[matched]
            more = places < ends[words]
            words, places = words[more], places[more]
        whose, tokens = (np.concatenate(parts) if parts else np.empty(0, np.int64) for parts in (whose, tokens))
        order = np.argsort(whose, kind="stable")
        return whose[order], tokens[order]

    def failing(self, whose: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Words with a pair of neighbours that merging would not leave side by side; every different pair is checked once."""
        inside = np.flatnonzero(whose[1:] == whose[:-1])
        keys, which = np.unique(tokens[inside] << 20 | tokens[inside + 1], return_inverse=True)
        wrong = self.first_meeting(keys >> 20, keys & ((1 << 20) - 1)) < NEVER
        return np.unique(whose[inside[wrong[which]]])

    def merged(self, word: bytes) -> bytes:
        """Exact merging, as little-endian 64-bit ids: the pair of least rank first, from the left among equals."""
        ids = self.merged_words.get(word)
        if ids is None:
            ids = np.array(self._merge([self.names[bytes([b])] for b in word]), dtype="<i8").tobytes()
            if len(self.merged_words) < WORDS_KEPT and len(word) <= LONG_WORD:
                self.merged_words[word] = ids
        return ids

    def _merge(self, ids: list[int]) -> list[int]:
        ranks, made, end = self.ranks, self.made, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        waiting = [(rank, i) for i in range(end - 1) if (rank := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if ids[i] < 0 or j >= end or ranks.get(ids[i] << 20 | ids[j]) != rank:
                continue  # one of the two has been used up since
            ids[i], ids[j] = int(made[rank]), -1
            k = after[i] = after[j]
            if k < end:
                before[k] = i
                if (new := ranks.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(waiting, (new, i))
            h = before[i]
            if h >= 0 and (new := ranks.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(waiting, (new, h))
        return [i for i in ids if i >= 0]

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, white space or other, as the library's own splitter sees each character; asked once per character."""
        kinds = self.kinds[points]
        if not kinds.all():
            for point in np.unique(points[kinds == 0]).tolist():
                cuts = lambda text: [b for _, (_, b) in self.splitter.pre_tokenize_str(text)]
                c = chr(point)
                self.kinds[point] = (LETTER if cuts(f"a{c}!")[0] == 2 else NUMBER if cuts(f"1{c}!")[0] == 2 else OTHER if cuts(f"a{c}!")[-2:] == [1, 3] else WHITE)
            kinds = self.kinds[points]
        return kinds

    def pre_tokens(self, text: bytes, starts: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Byte offsets at which pre-tokens begin in segments that begin at ``starts``; segments marked ``whole`` are one each."""
        if text.isascii():
            points, places = np.frombuffer(text, dtype=np.uint8), None
        else:
            points = np.frombuffer(text.decode().encode("utf-32-le"), dtype="<u4")
            widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            places = np.cumsum(widths) - widths
            starts = np.searchsorted(places, starts)
        n = len(points)
        kinds = self.kinds_of(points)
        begin = np.zeros(n + 1, dtype=bool)
        begin[starts] = True
        begin = begin[:n]
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = kinds[:-1], kinds[1:]
        inner = starts[(starts > 0) & (starts < n)]
        before[inner], after[inner - 1] = 0, 0
        white, blank = kinds == WHITE, np.zeros(n, dtype=bool)
        blank[1:] = points[:-1] == 0x20
        begin |= np.where(white, (before != WHITE) | ((after != WHITE) & (after != 0)), np.where(before == WHITE, ~blank, before != kinds))
        self._part_endings(points, starts, begin)
        for i in np.flatnonzero(whole).tolist():
            begin[starts[i] + 1:starts[i + 1] if i + 1 < len(starts) else n] = False
        found = np.flatnonzero(begin)
        return found if places is None else places[found]

    @staticmethod
    def _part_endings(points: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> None:
        """An apostrophe that begins a pre-token takes one of the fixed endings with it and nothing more."""
        quotes = np.flatnonzero((points == ord("'")) & begin)
        bounds = np.r_[starts, len(points)]
        ends = bounds[np.searchsorted(bounds, quotes, side="right")]
        padded = np.r_[points[:].astype(np.int64), 0, 0]
        for length, endings in enumerate(ENDINGS, 1):
            fits = quotes + length < ends
            named = np.zeros(len(quotes), dtype=bool)
            for ending in endings:
                named |= np.all([padded[np.minimum(quotes + 1 + i, len(padded) - 1)] == ord(c) for i, c in enumerate(ending)], axis=0)
            chosen, stop = quotes[fits & named], ends[fits & named]
            begin[chosen + 1] = False
            behind = chosen + length + 1
            begin[behind[behind < stop]] = True

    def segments(self, text: bytes) -> Iterator[tuple[bytes, bool]]:
        """A text parted at special tokens (which stand whole) and, if it is long, at single spaces between ASCII letters, which always begin a pre-token."""
        at = 0
        while True:
            next_one = min(((found, name) for name in self.special if (found := text.find(name, at)) >= 0), key=lambda f: (f[0], -len(f[1])), default=None)
            stop = next_one[0] if next_one else len(text)
            while stop - at > BYTES_AT_ONCE:
                cut = at + BYTES_AT_ONCE // 2
                while (cut := text.find(b" ", cut + 1, stop - 1)) >= 0 and not (text[cut - 1:cut].isalpha() and text[cut + 1:cut + 2].isalpha()):
                    pass
                if cut < 0:
                    break
                yield text[at:cut], False
                at = cut
            if stop > at:
                yield text[at:stop], False
            if not next_one:
                return
            yield next_one[1], True
            at = stop + len(next_one[1])

    def encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and the number of ids of each."""
        counts = np.zeros(len(texts), dtype=np.int64)
        pieces = [(i, *piece) for i, text in enumerate(texts) for piece in self.segments(text)]
        out = []
        for some in portions([len(p[1]) for p in pieces], BYTES_AT_ONCE):
            of_text, parts, whole = zip(*pieces[some])
            ids, bounds = self._encoded_portion(parts, np.array(whole))
            out.append(ids)
            np.add.at(counts, list(of_text), np.diff(bounds))
        return np.concatenate(out) if out else np.empty(0, np.int64), counts

    def _encoded_portion(self, parts: tuple[bytes, ...], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = b"".join(parts)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        begins = self.pre_tokens(text, starts, whole)
        offsets = np.r_[begins, len(text)].astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).dictionary_encode()
        words = held.dictionary
        _, word_offsets, data = words.buffers()
        bounds = np.frombuffer(word_offsets, dtype=np.int32)[:len(words) + 1].astype(np.int64)
        ids, counts = self.encoded_words(np.frombuffer(data, dtype=np.uint8), bounds)
        place = held.indices.to_numpy(zero_copy_only=False)
        first, lengths = (np.cumsum(counts) - counts)[place], counts[place]
        ends = np.cumsum(lengths)
        order = np.arange(int(ends[-1])) + np.repeat(first - (ends - lengths), lengths)
        return ids[order], np.r_[0, ends][np.searchsorted(begins, np.r_[starts, len(text)])]

    def encoded_words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words in a row, and the number of ids of each."""
        whose, ids = self.proposed(data, bounds)
        failing = self.failing(whose, ids)
        repaired = {i: self.merged(data[bounds[i]:bounds[i + 1]].tobytes()) for i in failing.tolist()}
        by_size = np.flatnonzero(np.isin(bounds[1:] - bounds[:-1], [len(s) for s in self.special]))
        for i in by_size.tolist():
            if (word := data[bounds[i]:bounds[i + 1]].tobytes()) in self.special:
                repaired[i] = self.special[word].to_bytes(8, "little")
        if repaired:
            again = np.array(sorted(repaired), dtype=np.int64)
            keep = ~np.isin(whose, again)
            lists = [repaired[i] for i in again.tolist()]
            whose = np.r_[whose[keep], np.repeat(again, [len(x) // 8 for x in lists])]
            ids = np.r_[ids[keep], np.frombuffer(b"".join(lists), dtype="<i8")]
            order = np.argsort(whose, kind="stable")
            whose, ids = whose[order], ids[order]
        return ids, np.bincount(whose, minlength=len(bounds) - 1)


def pair_vocabulary(path: str) -> PairVocabulary:
    """The worker's tables for a vocabulary file."""
    if path not in _vocabularies:
        _vocabularies[path] = PairVocabulary(path)
    return _vocabularies[path]


def spellings(path: str) -> list[bytes]:
    """What each id of a vocabulary file spells; nothing for ids that it lacks."""
    if path not in _spellings:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        special = {t["id"]: t["content"].encode() for t in held["added_tokens"]}
        spelled = {number: bytes(byte_of[c] for c in token) for token, number in held["model"]["vocab"].items() if number not in special} | special
        _spellings[path] = [spelled.get(i, b"") for i in range(1 + max(spelled))]
    return _spellings[path]


def encode_content(media_content: DataFrame, vocabulary: str) -> DataFrame:
    """``(uri, n_tokens, ids ARRAY<INT>)`` of fetched ``media_content(uri, content)`` under the pair vocabulary in the file ``vocabulary``.

    The ids are those of the ``tokenizers`` library, where the text of a special token is that token. Null content is
    empty: no ids. Rows stand each for itself (repeated or null ``uri`` alike), other columns are ignored, and an empty
    table gives an empty table. A text of any length is encoded whole; it is held in stretches that begin where a pre-token must begin.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pair_vocabulary(vocabulary)
        for batch in batches:
            texts = raw(batch.column(1))
            for some in portions([len(t) for t in texts], BYTES_AT_ONCE):
                ids, counts = held.encoded(texts[some])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], pa.array(counts), lists], ["uri", "n_tokens", "ids"])

    kind = media_content.schema["uri"].dataType.simpleString()
    return media_content.select("uri", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).mapInArrow(
        run, f"uri {kind}, n_tokens bigint, ids array<int>")


def decode_content(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``(uri, n_tokens, ids, content)`` of ``encoded(uri, n_tokens, ids)``: the text that the ids spell, special tokens included.

    Null ids spell the empty text; ids that the vocabulary lacks, and null entries, are skipped; bytes that are no UTF-8 become U+FFFD.
    Rows stand each for itself, other columns are ignored, and an empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = pa.array(spellings(vocabulary), pa.binary())
        lengths = pc.binary_length(spelling).to_numpy()
        for batch in batches:
            lists = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (ids >= 0) & (ids < len(spelling))
            parts = spelling.take(pa.array(np.where(known, ids, 0)))
            sizes = np.where(known, lengths[np.where(known, ids, 0)], 0).astype(np.int64)
            if not known.all():
                parts = pc.if_else(pa.array(known), parts, pa.scalar(b"", pa.binary()))
            text = b"".join(parts.to_pylist()) if parts.offset or not known.all() else parts.buffers()[2].to_pybytes()
            ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))]].tolist()
            texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["uri", "n_tokens", "ids", "content"])

    kind = encoded.schema["uri"].dataType.simpleString()
    return encoded.select("uri", "n_tokens", "ids").mapInArrow(run, f"uri {kind}, n_tokens bigint, ids array<int>, content string")
