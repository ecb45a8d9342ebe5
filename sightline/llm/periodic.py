"""Periodic runs in fetched content: stretches of words that repeat themselves, from suffix trees, and the text without the repeats.

A menu, a caption loop or a stuck template repeats with some period. Every maximal repetition has a Lyndon root under one of the two
orders of its words, and the longest Lyndon word that begins at a place ends where the next smaller suffix begins.
So each place gives two candidate roots; each is extended in both directions by longest common extensions, in constant
time: the lowest common ancestor of two leaves in Ukkonen's suffix tree of the words (to the right) or of their
reversal (to the left), by range minima over the tree's Euler tour.

Before a tree is built, words that no run of four periods can hold are set aside: every three words in a row that lie in
such a run lie there three times. That test only ever sets aside what no run contains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import portions, raw

LEAST_LENGTH, LEAST_PERIODS = 6, 4
BYTES_AT_ONCE = 4 << 20
TREE_WORDS = 1 << 16  # stretches share a tree up to this size; a longer one has its own
MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)  # any odd numbers do


class SuffixTree:
    """Ukkonen's tree of a row of integers in which every negative one occurs once, and the last one is negative.

    Leaf ``i`` is the suffix from ``i``; inner nodes follow. Words are compared by number, negative ones (which end a stretch) come first.
    """

    def __init__(self, text: list[int]) -> None:
        self.size = n = len(text)
        self.kids: list[dict[int, int]] = [{}]  # of the inner nodes; node n is the root
        begin, stop, link = [0], [0], [n]
        leaf_begin = [0] * n
        root = node = n
        kids = self.kids
        edge = length = waiting = 0
        for i, word in enumerate(text):
            waiting += 1
            fresh = 0  # the inner node that still needs its suffix link
            while waiting:
                if not length:
                    edge = i
                below = kids[node - n]
                child = below.get(text[edge])
                if child is None:
                    leaf = i - waiting + 1
                    below[text[edge]] = leaf
                    leaf_begin[leaf] = edge
                    if fresh:
                        link[fresh - n] = node
                        fresh = 0
                else:
                    if child < n:
                        first = leaf_begin[child]
                        span = i + 1 - first
                    else:
                        first = begin[child - n]
                        span = stop[child - n] - first
                    if length >= span:
                        node = child
                        edge += span
                        length -= span
                        continue
                    if text[first + length] == word:
                        length += 1
                        if fresh:
                            link[fresh - n] = node
                        break
                    split = n + len(kids)
                    leaf = i - waiting + 1
                    kids.append({text[first + length]: child, word: leaf})
                    begin.append(first)
                    stop.append(first + length)
                    link.append(root)
                    leaf_begin[leaf] = i
                    if child < n:
                        leaf_begin[child] = first + length
                    else:
                        begin[child - n] = first + length
                    below[text[edge]] = split
                    if fresh:
                        link[fresh - n] = split
                    fresh = split
                waiting -= 1
                if node == root:
                    if length:
                        length -= 1
                        edge = i - waiting + 1
                else:
                    node = link[node - n]
        self.spans = [b - a for a, b in zip(begin, stop)]

    def tour(self, ends_first: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The leaves in order, and the depth of the lowest common ancestor of each leaf and the one before it.

        ``ends_first`` says whether negative words come before or after all others.
        """
        n, kids, spans = self.size, self.kids, self.spans
        depth = [0] * len(kids)
        leaves, heights = [], []
        low = 0
        stack = [n]
        while stack:
            at = stack.pop()
            if at < 0:  # back at an inner node, on the way to its next child
                low = depth[-at - n]
                continue
            if at < n:
                leaves.append(at)
                heights.append(low)
                continue
            below = kids[at - n]
            words = sorted(below)
            if not ends_first and words[0] < 0:
                cut = 0
                while cut < len(words) and words[cut] < 0:
                    cut += 1
                words = words[cut:] + words[:cut]
            here = depth[at - n]
            for word in reversed(words):
                child = below[word]
                stack.append(child)
                stack.append(-at)
                if child >= n:
                    depth[child - n] = here + spans[child - n]
            stack.pop()  # the first child is entered without coming back
        return np.array(leaves, dtype=np.int64), np.array(heights, dtype=np.int32)


class Extensions:
    """Longest common extensions of suffixes by range minima over a tour."""

    def __init__(self, leaves: np.ndarray, heights: np.ndarray) -> None:
        self.rank = np.empty(len(leaves), dtype=np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.levels = [heights]
        while 2 << len(self.levels) - 1 <= len(heights):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes from ``a`` and from ``b`` (another one) have in common at their beginning."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            found[some] = np.minimum(self.levels[k][low[some]], self.levels[k][high[some] - (1 << k)])
        return found


def next_smaller(rank: list[int]) -> np.ndarray:
    """Where the next smaller value stands; the row's length if there is none."""
    out, waiting = [len(rank)] * len(rank), []
    for i, value in enumerate(rank):
        while waiting and rank[waiting[-1]] > value:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(text: list[int]) -> np.ndarray:
    """``(start, length, period)`` of the runs in some stretches of words in a row, each with a negative number of its own behind it, in that order."""
    n = len(text)
    tree = SuffixTree(text)
    leaves, heights = tree.tour()
    right = Extensions(leaves, heights)
    other = np.empty(n, dtype=np.int64)
    other[tree.tour(ends_first=False)[0]] = np.arange(n, 0, -1)  # ends still come first once the order of the words is turned round
    del tree
    words = np.flatnonzero(np.array(text) >= 0)
    places = np.r_[words, words]
    periods = np.r_[next_smaller(right.rank.tolist())[words], next_smaller(other.tolist())[words]] - places
    # Most candidates are too short to matter once they are extended to the right; only the others go to the left as well.
    ahead = right.common(places, places + periods)
    del right
    mirror = text[-2::-1] + [-n - 1]  # what ends before place i is its suffix n - 1 - i
    left = Extensions(*SuffixTree(mirror).tour())
    behind = left.common(n - 1 - places, n - 1 - places - periods)
    found = np.stack([places - behind, behind + periods + ahead, periods], axis=1)
    lengths = found[:, 1]
    return np.unique(found[(lengths >= LEAST_LENGTH) & (lengths >= LEAST_PERIODS * periods)], axis=0)


def candidates(codes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches begin and end that may hold a run, among the words ``codes`` of the ``texts`` (numbers that rise).

    Three words in a row that lie in a run lie in it three times. What a stretch lost may have been another's copy, so it goes on while much is lost.
    """
    place, group = np.arange(len(codes)), texts.astype(np.int64)
    while True:
        if len(place) < LEAST_LENGTH:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whole = (group[2:] == group[:-2]) & (place[2:] == place[:-2] + 2)
        at = np.flatnonzero(whole)
        mixed = codes[place[at]].astype(np.uint64) * MIXERS[0] ^ codes[place[at + 1]].astype(np.uint64) * MIXERS[1]
        mixed = (mixed ^ mixed >> np.uint64(29)) * MIXERS[2] + codes[place[at + 2]].astype(np.uint64) * MIXERS[3] + group[at].astype(np.uint64) * MIXERS[1]
        order = np.argsort(mixed, kind="stable")
        ordered = mixed[order]
        edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
        often = np.repeat(np.diff(edges) >= 3, np.diff(edges))
        good = np.zeros(len(place), dtype=bool)
        good[at[order[often]]] = True
        # A stretch is a row of good places and the two words behind it.
        steps = np.flatnonzero(good)
        breaks = np.r_[True, (np.diff(steps) > 1) | (group[steps[1:]] != group[steps[:-1]])] if len(steps) else np.empty(0, bool)
        first = np.flatnonzero(breaks)
        sizes = np.diff(np.r_[first, len(steps)]) + 2
        kept = sizes >= LEAST_LENGTH
        begins, sizes = steps[first[kept]], sizes[kept]
        total = int(sizes.sum())
        inside = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        before = len(place)
        place, group = place[inside], np.repeat(np.arange(len(sizes)), sizes)
        if total > 0.95 * before or not total:
            begins = place[np.cumsum(sizes) - sizes] if total else np.empty(0, np.int64)
            return begins, begins + sizes


def found_runs(codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The runs of each text, by start and period: rows ``(start, length, period)`` in words of the text."""
    texts = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    begins, ends = candidates(codes, texts)
    rows = []
    for some in portions((ends - begins).tolist(), TREE_WORDS):
        text: list[int] = []
        starts = []
        for number, (a, b) in enumerate(zip(begins[some].tolist(), ends[some].tolist()), 1):
            starts.append(len(text))
            text += codes[a:b].tolist()
            text.append(-number)
        runs = runs_of(text)
        which = np.searchsorted(starts, runs[:, 0], side="right") - 1
        runs[:, 0] += begins[some][which] - np.array(starts, dtype=np.int64)[which]
        rows.append(runs)
    runs = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
    owner = texts[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    runs[:, 0] -= bounds[owner]
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    return np.split(runs[order], np.searchsorted(owner[order], np.arange(1, len(bounds) - 1)))


def left_of(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds beyond its first period, with one space between."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(media_content: DataFrame) -> DataFrame:
    """``(uri, n_words, runs ARRAY<STRUCT<start, length, period>>, content)`` of fetched ``media_content(uri, content)``.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch with smallest period ``period`` and at
    least four periods and six words that cannot be made longer on either side; runs come by start, then period. The new ``content`` has the words that
    no run holds beyond its first ``period`` words, with one space between. Null content and text without words give 0
    words, no run and the empty text. Rows stand each for itself (repeated or null ``uri`` alike), other columns are ignored, an empty table
    gives an empty table. A text is held by one task, with memory in proportion to the words that may lie in a run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch.column(1))
            for some in portions([len(t) for t in texts], BYTES_AT_ONCE):
                words = [t.split() for t in texts[some]]
                bounds = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
                numbers: dict[bytes, int] = {}
                codes = np.fromiter((numbers.setdefault(w, len(numbers)) for of_text in words for w in of_text), dtype=np.int64, count=int(bounds[-1]))
                found = found_runs(codes, bounds)
                rows = np.concatenate(found)
                items = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])].astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[some], pa.array(np.diff(bounds)), lists, pa.array([left_of(w, r) for w, r in zip(words, found)], pa.binary()).cast(pa.string())],
                    ["uri", "n_words", "runs", "content"])

    kind = media_content.schema["uri"].dataType.simpleString()
    return media_content.select("uri", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).mapInArrow(
        run, f"uri {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, content string")
