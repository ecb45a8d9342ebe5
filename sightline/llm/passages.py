"""Passages that occur more than once, found by FM-index shards, and their removal.

Equal windows of words share their minimizer: the leftmost smallest hash among the word groups inside. A run of
windows with one minimizer is a *stretch*, and stretches go to the shard that the minimizer's hash names, so all
places where a window can recur lie in one shard, and a document is streamed only through the shards that can
answer. Each shard keeps its distinct stretches in an FM-index (a wavelet matrix over the Burrows-Wheeler
transform) and follows their windows by backward search.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf, portions, raw

WINDOW_WORDS = 35
GROUP_WORDS = 8
STRETCHES_PER_KEY = 2048  # a minimizer with more stretches is spread by whole windows
SHARD_WORDS = 200_000
WORDS_AT_ONCE = 400_000


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_groups(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes."""
    total = len(words) - size + 1
    h = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + words[j:j + total]
    return mixed(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    held, least = 1, values
    while 2 * held <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    return least if held == width else np.minimum(least[:len(values) - width + 1], least[width - held:])


def stretches(texts: list[bytes], window: int, group: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows and minimizer hash of each stretch of the given texts."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    if total < window:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    hashes = np.fromiter((crc32(w) for ws in words for w in ws), dtype=np.uint64, count=total)
    groups = word_groups(hashes, group)
    # A hash's upper half decides, the place in the lower half makes ties fall to the left.
    keyed = (groups & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(groups), dtype=np.uint64)
    place = (sliding_least(keyed, window - group + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[:len(place)]
    inside = np.arange(len(place)) + window <= ends[owner]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    fresh = np.r_[True, (place[at[1:]] != place[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])]
    first = np.flatnonzero(fresh)
    start = at[first]
    return (owner[start], start - (ends - sizes)[owner[start]], np.diff(np.r_[first, len(at)]), groups[place[start]].view(np.int64))


def row_key() -> list[Column]:
    """Two hashes of a row's identifier and content: a name that null and repeated identifiers cannot blur."""
    return [F.xxhash64("uri", "content").alias("k1"), F.xxhash64(F.lit("second"), "content", "uri").alias("k2")]


KEY = ["k1", "k2"]


def minimizer_stretches(keyed: DataFrame, window: int, group: int) -> DataFrame:
    """``(k1, k2, start, windows, route)`` of every stretch of ``keyed(k1, k2, content)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in raw(batch.column(2))]
            for some in portions([len(t) // 5 for t in texts], WORDS_AT_ONCE):
                owner, start, windows, route = stretches(texts[some], window, group)
                if len(owner):
                    rows = pa.array(owner + some.start)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)),
                                                      pa.array(windows.astype(np.int32)), pa.array(route)], [*KEY, "start", "windows", "route"])

    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, start int, windows int, route bigint")


def cut_stretches(held: DataFrame, window: int) -> DataFrame:
    """``(k1, k2, start, windows, route, digest, words)`` from ``held(k1, k2, content, hits)``; a hit marked ``hot`` is cut into its windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, text, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist()):
                words = text.split()
                for hit in hits:
                    start, windows = hit["start"], hit["windows"]
                    parts = [(s, 1) for s in range(start, start + windows)] if hit["hot"] else [(start, windows)]
                    for s, n in parts:
                        body = b" ".join(words[s:s + n + window - 1])
                        digest = xxhash.xxh3_128_digest(body)
                        route = int.from_bytes(digest[:8], "little", signed=True) if hit["hot"] else hit["route"]
                        out.append((k1, k2, s, n, route, digest, body))
                if len(out) >= 20_000:
                    yield pack(out)
                    out = []
            if out:
                yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        k1, k2, start, windows, route, digest, body = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(route),
                                           pa.array(digest, pa.binary()), pa.array(body, pa.binary())], [*KEY, "start", "windows", "route", "digest", "words"])

    return held.mapInArrow(run, "k1 bigint, k2 bigint, start int, windows int, route bigint, digest binary, words binary")


class WaveletMatrix:
    """Ranks over a sequence of symbols: one packed bit vector per binary digit, with a running count every 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=bool)
            padded[:len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.uint32)[:-1]].astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.starts = self._follow(np.arange(sigma), np.zeros(sigma, dtype=np.int64))

    def _follow(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            block = places >> 6
            below = self.bits[i][block] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[i][block] + np.bitwise_count(below)
            places = np.where(symbols >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._follow(symbols, places) - self.starts[symbols]


class FmIndex:
    """Backward search over texts joined by a separator; the suffixes are sorted as deep as the threshold asks."""

    def __init__(self, texts: list[np.ndarray], copies: np.ndarray, sigma: int, depth: int) -> None:
        sizes = np.array([len(t) + 1 for t in texts])
        joined = np.zeros(int(sizes.sum()), dtype=np.int64)
        for end, text in zip(np.cumsum(sizes), texts):
            joined[end - 1 - len(text):end - 1] = text
        n = len(joined)
        rank, width, near = joined, 1, None
        order = np.argsort(rank, kind="stable")
        while True:
            if width <= depth - 1 < 2 * width:
                near = (rank, width)
            if width > depth:
                break
            ahead = np.zeros(n, dtype=np.int64)
            ahead[:n - width] = rank[width:] + 1
            pair = rank * (int(ahead.max()) + 1) + ahead
            order = np.argsort(pair, kind="stable")
            ordered = pair[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            width *= 2
        self.matrix = WaveletMatrix(joined[order - 1], sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(joined, minlength=sigma))]
        weight = np.repeat(copies, sizes)[order]
        self.weight = np.r_[0, np.cumsum(weight)]
        # Rows that agree in one word less than the depth form a block; it is where a window without its last word lies.
        rank, width = near
        shift = np.minimum(order + (depth - 1 - width), n - 1)
        same = (rank[order][1:] == rank[order][:-1]) & (rank[shift][1:] == rank[shift][:-1])
        heads = np.flatnonzero(np.r_[True, ~same])
        block = np.cumsum(np.r_[True, ~same]) - 1
        self.block_low, self.block_high = heads[block], np.r_[heads[1:], n][block]
        self.size = n

    def left(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that start with a symbol and go on as the given rows do."""
        both = self.before[np.r_[symbols, symbols]] + self.matrix.rank(np.r_[symbols, symbols], np.r_[low, high])
        return both[:len(low)], both[len(low):]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_windows(texts: list[bytes], copies: list[int], window: int) -> list[bytes]:
    """Per distinct stretch, a bit for each of its windows: does it occur twice or more in the shard?

    The matching statistic of a place is followed from right to left and held at the threshold: one backward step
    per word, after the last word of the window before has been let go.
    """
    ids: dict[bytes, int] = {}
    coded = [np.fromiter((ids.setdefault(w, len(ids) + 1) for w in t.split()), dtype=np.int64) for t in texts]
    index = FmIndex(coded, np.array(copies, dtype=np.int64), len(ids) + 1, window)
    sizes = np.array([len(c) for c in coded])
    ends = np.cumsum(sizes)
    flat = np.concatenate(coded)
    marks = np.zeros(len(flat), dtype=bool)
    live = np.arange(len(coded))
    low, high = np.zeros(len(coded), np.int64), np.full(len(coded), index.size, np.int64)
    for back in range(1, int(sizes.max()) + 1):
        going = sizes[live] >= back
        live, low, high = live[going], low[going], high[going]
        place = ends[live] - back
        if back > window:  # rows of the last window without its last word
            low, high = index.block_low[low], index.block_high[low]
        low, high = index.left(flat[place], low, high)
        if back >= window:
            marks[place] = index.occurrences(low, high) >= 2
    return [np.packbits(marks[e - s:e - window + 1]).tobytes() for s, e in zip(sizes, ends)]


def shard_answers(distinct: DataFrame, shards: int, window: int) -> DataFrame:
    """``(digest, marks)`` for ``distinct(route, digest, words, copies)``: each shard is indexed and streamed by one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != shard and held:
                    yield answer(held)
                    held = []
                shard = row[0]
                held.append(row)
        if held:
            yield answer(held)

    def answer(held: list[tuple]) -> pa.RecordBatch:
        _, digests, texts, copies = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(repeated_windows(list(texts), list(copies), window), pa.binary())],
                                          ["digest", "marks"])

    return (distinct.select(F.pmod("route", F.lit(shards)).cast("int").alias("shard"), "digest", "words", "copies")
            .repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "digest binary, marks binary"))


def without_passages(held: DataFrame, window: int) -> DataFrame:
    """``(uri, content, n_words, n_removed, spans)`` from ``held(uri, content, hits)``; ``spans`` are removed stretches of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed, spans = [], [], [], []
            for text, hits in zip(raw(batch.column(1)), batch.column(2).to_pylist()):
                words = (text or b"").split()
                counts.append(len(words))
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for hit in hits or []:
                    marks = np.unpackbits(np.frombuffer(hit["marks"], np.uint8), count=hit["windows"])
                    at = hit["start"] + np.flatnonzero(marks)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if removed[-1] else words
                texts.append(b" ".join(kept))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span)],
                ["uri", "content", "n_words", "n_removed", "spans"])

    kind = held.schema["uri"].dataType.simpleString()
    return held.mapInArrow(run, f"uri {kind}, content string, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>")


def repeated_passages(media_content: DataFrame, window: int = WINDOW_WORDS, group: int = GROUP_WORDS,
                      stretches_per_key: int = STRETCHES_PER_KEY, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(uri, content, n_words, n_removed, spans)`` per row of ``media_content(uri, content)``, without passages that recur.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in this text or another;
    all windows are judged on the input, so every copy goes, the first too. ``content`` holds the words that stay,
    joined by single spaces; ``spans`` the removed word ranges. Null content has no word. Repeated rows count as
    copies of each other, null ``uri`` or not; other columns are ignored; an empty table gives an empty table.

    Minimizers that occur once in the corpus cannot lie in a recurring window and leave first. One that is as common
    as a passage in a third of all texts is spread by the hash of whole windows, and equal stretches are counted
    before they are indexed, so a shard holds distinct stretches only.
    """
    shelf = Shelf(media_content.sparkSession, "passages")
    source = media_content.select("uri", F.col("content").cast("string").alias("content"))
    keyed = source.select(*row_key(), "content").where("content IS NOT NULL")
    found = shelf.keep(minimizer_stretches(keyed, window, group), "stretches")
    common = shelf.keep(found.groupBy("route").count().where("count > 1"), "common")
    hits = found.join(common, "route").select(*KEY, F.struct("start", "windows", "route", (F.col("count") > stretches_per_key).alias("hot")).alias("hit"))
    of_text = shelf.keep(hits.groupBy(*KEY).agg(F.collect_set("hit").alias("hits")), "hits")
    shelf.drop(found)
    cut = shelf.keep(cut_stretches(keyed.join(of_text, KEY).select(*KEY, "content", "hits"), window), "cut")
    distinct = shelf.keep(cut.groupBy("route", "digest", "words").agg(F.count("*").alias("copies")), "distinct")
    words = distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(words // (6 * shard_words), 4 * int(shelf.spark.conf.get("spark.sql.shuffle.partitions")) if words > shard_words else 1)
    answers = shelf.keep(shard_answers(distinct, shards, window), "answers")
    recurring = answers.where(F.col("marks") != F.rpad(F.lit(b""), F.length("marks"), F.lit(b"\x00")))
    marked = cut.select(*KEY, "start", "windows", "digest").distinct().join(recurring, "digest")
    removals = shelf.keep(marked.groupBy(*KEY).agg(F.collect_set(F.struct("start", "windows", "marks")).alias("hits")), "removals")
    shelf.drop(common, of_text, cut, distinct, answers)
    whole = source.select("uri", "content", *row_key()).join(removals, KEY, "left")
    return without_passages(whole.select("uri", "content", "hits"), window)


