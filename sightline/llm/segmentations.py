"""Distinct random segmentations of texts into SentencePiece pieces: Gumbel top-k by perturbed A* search.

Every segmentation of a text is a path through its lattice of pieces, with probability proportional to the product of
its pieces' weights. Adding Gumbel noise to the log-probabilities of all paths and taking the ``k`` greatest is sampling
without replacement. The search never lists the paths: a node of the search is a set of paths (a common beginning,
and some pieces excluded after it), its bound is the greatest perturbed value inside, drawn from a Gumbel truncated at
its parent's, and opening the best node yields one path and the nodes that branch off along it (Maddison et al., 2014;
Kool et al., 2019).

Pieces never reach across a word start, so a text's lattice is the chain of its words' lattices. A task builds the
lattices of the different words of a portion once, in columns, and searches all texts of the portion side by side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import portions

SPACE = "▁"
SAMPLES = 2
SEED = 11
SHARPNESS = 1.0
BYTE_COST = 12.0  # minus log-weight of a byte that stands for part of an unknown character
CHARACTERS_AT_ONCE = 3 << 18
GRAIN = 2.0 ** 30
NOISE_SPAN = 42.0  # Gumbel noise of 53 random bits lies between -3.7 and 37.5

MARK = "\x01"

_models: dict[tuple, PieceModel] = {}


@dataclass
class Words:
    """The words of some texts: different words, the place of each text's words among them, and words per text."""

    different: list[str]
    place: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, lists: list[list[str]]) -> Words:
        ids: dict[str, int] = {}
        place = np.array([ids.setdefault(u, len(ids)) for units in lists for u in units], dtype=np.int64)
        return cls(list(ids), place, np.array([len(units) for units in lists], dtype=np.int64))


class PieceModel:
    """The pieces of a SentencePiece file as a trie in sorted arrays, with log-weights.

    The file holds merge ranks, no probabilities; weights follow Zipf's law over the ranks, to the power of ``sharpness``
    (small values make segmentations more varied).
    """

    def __init__(self, path: str, sharpness: float = SHARPNESS) -> None:
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_file=path)
        self.processor = held
        pieces = {i: held.id_to_piece(i) for i in range(held.get_piece_size())
                  if not (held.is_control(i) or held.is_unknown(i) or held.is_unused(i) or held.is_byte(i))}
        self.byte_ids = np.array([held.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.has_bytes = not held.is_unknown(int(self.byte_ids[0]))
        self.unknown = held.unk_id()
        first = min(pieces, default=0)
        self.weights = np.zeros(held.get_piece_size())
        for i in pieces:
            self.weights[i] = -sharpness * np.log(i - first + 2.0)
        self.weights[self.byte_ids] = -BYTE_COST * sharpness
        self.weights[self.unknown] = -2 * BYTE_COST * sharpness
        states: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, piece in pieces.items():
            state = 0
            for c in map(ord, piece):
                state = states.setdefault((state, c), len(states) + 1)
            ends[state] = i
        self._hash_moves(states)
        self.openers = np.zeros(1 << 16, dtype=np.int64)  # state after a first character of the basic plane, 0: none
        for (s, c), t in states.items():
            if s == 0 and c < len(self.openers):
                self.openers[c] = t
        self.ends = np.full(len(states) + 1, -1, dtype=np.int64)
        self.ends[list(ends)] = list(ends.values())
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces.values())
        breaks = "" if inner or any("\n" in p for p in pieces.values()) else "\n"
        self.splits = not inner and bool(breaks)
        self.unit = re.compile("[\\s\\S]+" if inner else f"{SPACE}+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+" + ("|\n" if breaks else ""))

    def _hash_moves(self, states: dict[tuple[int, int], int]) -> None:
        """The trie's moves in an open hash table of a fixed few probes, kept at a quarter full at most."""
        keys = np.array([s << 21 | c for s, c in states], dtype=np.int64)
        targets = np.array(list(states.values()), dtype=np.int64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.targets = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        waiting, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(waiting):
            free = self.keys[slot] == -1
            taken, once = np.unique(slot[free], return_index=True)
            rows = np.flatnonzero(free)[once]
            self.keys[taken], self.targets[taken] = keys[waiting[rows]], targets[waiting[rows]]
            rest = np.ones(len(waiting), dtype=bool)
            rest[rows] = False
            waiting, slot = waiting[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, states: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The state that each state and character lead to, 0 where there is none."""
        keys = states << 21 | points
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.targets[slot], 0)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there, wanted = self.keys[slot], keys[open_]
            hit = there == wanted
            out[open_[hit]] = self.targets[slot[hit]]
            going = ~hit & (there != -1)
            open_, slot = open_[going], slot[going]
        return out

    def units(self, text: str) -> list[str]:
        """The words of a text, each with the space before it; a line end is a word of its own."""
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def columns(self, texts: pa.Array) -> Words:
        """The same for many texts, in columns: Arrow puts a mark at each cut, splits there and names different words."""
        if not self.splits or pc.any(pc.match_substring(texts, MARK)).as_py():
            return Words.of([self.units(t) for t in texts.to_pylist()])
        spaced = pc.binary_join_element_wise(pa.scalar(SPACE), pc.replace_substring(texts, " ", SPACE), pa.scalar(""))
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(""), spaced)
        cut = pc.replace_substring(pc.replace_substring_regex(spaced, f"({SPACE}+)", f"{MARK}\\1"), "\n", f"{MARK}\n{MARK}")
        lists = pc.split_pattern(cut, MARK)
        held = lists.flatten().dictionary_encode()
        place = held.indices.to_numpy(zero_copy_only=False)
        words = held.dictionary.to_pylist()
        owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        if "" in words:  # between two marks, and before a first one
            real = place != words.index("")
            place, owner = place[real], owner[real]
        return Words(words, place, np.bincount(owner, minlength=len(texts)))


def piece_model(path: str, sharpness: float = SHARPNESS) -> PieceModel:
    if (path, sharpness) not in _models:
        _models[path, sharpness] = PieceModel(path, sharpness)
    return _models[path, sharpness]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from hashes."""
    return ((mixed(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def scaled(number: int, factor: int) -> np.uint64:
    return np.uint64(number * factor & 0xFFFFFFFFFFFFFFFF)


def streams(keys: np.ndarray, purpose: int, turn: int, places: np.ndarray) -> np.ndarray:
    """A hash per key, purpose, turn and place; it seeds one draw."""
    return mixed(keys + scaled(purpose * 1_000_003 + turn, 0x9E3779B97F4A7C15)) + places.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


class Lattices:
    """Lattices of different words: edges grouped by node, with the chance of each edge given its node."""

    def __init__(self, units: list[str], model: PieceModel) -> None:
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)  # a word has one node more than characters
        unit = np.repeat(np.arange(len(units)), sizes)
        char = np.arange(len(points))
        node = char + unit
        room = np.repeat(np.cumsum(sizes), sizes) - char
        nodes = int(sizes.sum()) + len(units)
        origin, reach, piece = [], [], []
        state, at, depth = np.zeros(len(points), dtype=np.int64), char, 0
        single = np.zeros(len(points), dtype=bool)
        while len(at):
            if depth == 0 and int(points.max()) < len(model.openers):
                state = model.openers[points]
                match = state > 0
                at, state = at[match], state[match]
            else:
                state = model.move(state, points[at + depth])
                match = state > 0
                at, state = at[match], state[match]
            depth += 1
            ends = model.ends[state]
            found = ends >= 0
            origin.append(node[at[found]])
            reach.append(node[at[found]] + depth)
            piece.append(ends[found])
            if depth == 1:
                single[at[found]] = True
            more = room[at] > depth
            at, state = at[more], state[more]
        bare = np.flatnonzero(~single)
        if len(bare):
            # An unknown character goes by its bytes: an ASCII one by its byte's id, others as minus the code point.
            origin.append(node[bare])
            reach.append(node[bare] + 1)
            ascii_ids = model.byte_ids[np.minimum(points[bare], 127)] if model.has_bytes else np.full(len(bare), model.unknown)
            piece.append(np.where((points[bare] < 128) | (not model.has_bytes), ascii_ids, -points[bare]))
        origin, reach, piece = np.concatenate(origin), np.concatenate(reach), np.concatenate(piece)
        left = np.zeros(nodes, dtype=np.int64)
        left[node] = room
        order = np.argsort(left[origin] << 32 | origin, kind="stable")
        self.origin, self.reach, self.piece = (column[order].astype(np.int32) for column in (origin, reach, piece))
        width = np.where(self.piece >= 0, 1, 1 + (-self.piece >= 0x80) + (-self.piece >= 0x800) + (-self.piece >= 0x10000))
        weight = np.where(self.piece >= 0, model.weights[np.maximum(self.piece, 0)], model.weights[model.byte_ids[0]] * width)
        distance = left[self.origin]
        after = np.zeros(nodes)
        value = np.empty(len(weight))
        cuts = np.flatnonzero(np.r_[True, distance[1:] != distance[:-1]]) if len(distance) else np.empty(0, np.int64)
        heads = np.flatnonzero(np.r_[True, self.origin[1:] != self.origin[:-1]]) if len(distance) else np.empty(0, np.int64)
        for a, b in zip(cuts, np.r_[cuts[1:], len(distance)]):
            value[a:b] = weight[a:b] + after[self.reach[a:b]]
            inside = heads[np.searchsorted(heads, a):np.searchsorted(heads, b)]
            after[self.origin[inside]] = np.logaddexp.reduceat(value[a:b], inside - a)
        # In steps of 2 ** -30 sums over a portion are exact, so they don't depend on what else the portion holds.
        self.log_chance = np.rint(np.minimum(value - after[self.origin], 0.0) * GRAIN) / GRAIN
        self.chance = np.exp(self.log_chance)
        self.first = np.zeros(nodes, dtype=np.int32)
        self.degree = np.zeros(nodes, dtype=np.int32)
        counts = np.diff(np.r_[heads, len(distance)])
        self.first[self.origin[heads]] = heads
        self.degree[self.origin[heads]] = counts
        self.log_chance[heads[counts == 1]] = 0.0
        self.chance[heads[counts == 1]] = 1.0
        share = np.rint(self.chance * GRAIN) / GRAIN
        total = np.cumsum(share)
        self.upto = total - np.repeat((total - share)[heads], counts)
        self.upto[heads + counts - 1] = 2.0

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random path from each node to its word's end: edges in order, and the number of edges per node."""
        taken, who, live, now = [], [], np.arange(len(nodes)), nodes
        counts = np.zeros(len(nodes), dtype=np.int64)
        step = 0
        going = self.degree[now] > 0
        live, now = live[going], now[going]
        while len(live):
            draw = uniform(seeds[live] + scaled(step, 0xA0761D6478BD642F))
            edge = self.first[now]
            wait = np.flatnonzero(self.upto[edge] < draw)
            while len(wait):
                edge[wait] += 1
                wait = wait[self.upto[edge[wait]] < draw[wait]]
            taken.append(edge)
            who.append(live)
            counts[live] += 1
            now = self.reach[edge]
            going = self.degree[now] > 0
            live, now = live[going], now[going]
            step += 1
        begins = np.cumsum(counts) - counts
        edges = np.empty(int(counts.sum()), dtype=np.int32)
        for step, (edge, live) in enumerate(zip(taken, who)):
            edges[begins[live] + step] = edge
        return edges, counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


COLUMNS = ("origin", "reach", "piece", "log_chance", "chance", "upto")
EDGES_KEPT = 3_000_000  # of a worker's known words; a full store is emptied, which costs time and changes nothing


class LatticeStore(Lattices):
    """Lattices of all words that a worker has met; only new words are built."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.known = model, {}
        self.nodes = self.edges = 0
        self.room: dict[str, np.ndarray] = {}

    def add(self, units: list[str]) -> None:
        """Make sure that every word is known."""
        fresh = list(set(units).difference(self.known))
        if not fresh:
            return
        if self.edges > EDGES_KEPT:
            self.known, self.nodes, self.edges = {}, 0, 0
            fresh = list(set(units))
        more = Lattices(fresh, self.model)
        starts = more.starts + self.nodes
        for name, shift in (("origin", self.nodes), ("reach", self.nodes), ("first", self.edges)):
            setattr(more, name, getattr(more, name) + np.int32(shift))
        for name in COLUMNS:
            self._put(name, self.edges, getattr(more, name))
        for name in ("first", "degree"):
            self._put(name, self.nodes, getattr(more, name))
        self.nodes += len(more.first)
        self.edges += len(more.piece)
        self.known.update(zip(fresh, starts.tolist()))
        for name, column in self.room.items():
            setattr(self, name, column[:self.edges if name in COLUMNS else self.nodes])

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = self.room.get(name)
        if held is None or len(held) < at + len(values):
            grown = np.empty(5 * (at + len(values)) // 4, dtype=values.dtype)
            if held is not None:
                grown[:at] = held[:at]
            self.room[name] = held = grown
        held[at:at + len(values)] = values


@dataclass
class Paths:
    """One path for each of some texts: flat edges with their words, and the bounds of the nodes that branch off."""

    texts: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    edges: np.ndarray
    words: np.ndarray
    before: np.ndarray
    bounds: np.ndarray
    log_chance: np.ndarray
    value: np.ndarray
    branch: np.ndarray  # step from which the path is its own
    closed: np.ndarray  # edges excluded at that step, one row per text


def new_paths(lattices: Lattices, texts, counts, edges, words, keys, turn, value, branch, closed) -> Paths:
    begins = np.cumsum(counts) - counts
    logs = lattices.log_chance[edges]
    total = np.cumsum(logs)
    base = np.repeat(total[begins] - logs[begins], counts)
    before = total - logs - base
    step = ranges(np.zeros(len(counts), np.int64), counts)
    rest = 1.0 - lattices.chance[edges]
    at = begins + branch
    own = branch >= 0
    if own.any():
        shut = np.where(closed[own] >= 0, lattices.chance[closed[own]], 0.0).sum(axis=1)
        rest[at[own]] = 1.0 - shut
        # Where every edge of a node is excluded, rounding must not leave a rest.
        full = (closed[own] >= 0).sum(axis=1) >= lattices.degree[lattices.origin[edges[at[own]]]]
        rest[at[own][full]] = 0.0
    rest[step < np.repeat(branch, counts)] = 0.0  # a node's only edge has chance 1, so nothing is left there either
    bounds = np.full(len(edges), -np.inf)
    open_ = np.flatnonzero(rest > 0)
    owner = np.repeat(np.arange(len(counts)), counts)[open_]
    mass = before[open_] + np.log(rest[open_])
    # Noise of 53 bits lies within NOISE_SPAN, so a node that far below as many nodes as there will be samples is never
    # opened, and needs no bound.
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    lengths = np.diff(np.r_[heads, len(owner)])
    early = ranges(heads, np.minimum(lengths, closed.shape[1]))
    least = np.full(len(counts), -np.inf)
    if len(heads):
        taken = np.minimum(lengths, closed.shape[1])
        least[owner[heads]] = np.where(lengths >= closed.shape[1], np.minimum.reduceat(mass[early], np.cumsum(taken) - taken), -np.inf)
    near = np.flatnonzero(mass >= least[owner] - NOISE_SPAN)
    open_, owner, mass = open_[near], owner[near], mass[near]
    noise = -np.log(-np.log(uniform(streams(keys[owner], 2, turn, step[open_]))))
    bounds[open_] = -np.logaddexp(-value[owner], -(mass + noise))
    return Paths(texts, begins, counts, edges, words, before, bounds, before[begins + counts - 1] + logs[begins + counts - 1], value, branch, closed)


def sampled_paths(words: Words, keys: np.ndarray, lattices: LatticeStore, samples: int) -> tuple[list[Paths], np.ndarray]:
    """For texts with at least one word: one ``Paths`` per sample, and each text's next perturbed value (minus infinity: no more path)."""
    lattices.add([w for w in words.different if w])
    starts = np.array([lattices.known.get(w, -1) for w in words.different], dtype=np.int64)[words.place]
    sizes = words.sizes
    opens = np.cumsum(sizes) - sizes
    n = len(sizes)
    word = ranges(np.zeros(n, np.int64), sizes)
    edges, steps = lattices.walk(starts, streams(np.repeat(keys, sizes), 1, 0, word))
    counts = np.add.reduceat(steps, opens)
    value = -np.log(-np.log(uniform(streams(keys, 0, 0, np.zeros(n, np.int64)))))
    none = np.full(n, -1)
    found = [new_paths(lattices, np.arange(n), counts, edges, np.repeat(word.astype(np.int32), steps), keys, 0, value, none, np.full((n, samples + 1), -1))]
    for turn in range(1, samples + 1):
        best, source, place = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, paths in enumerate(found):
            top = np.maximum.reduceat(paths.bounds, paths.begins)
            at = np.flatnonzero(paths.bounds == np.repeat(top, paths.counts))
            owner, once = np.unique(np.repeat(np.arange(len(paths.texts)), paths.counts)[at], return_index=True)
            spot = at[once]
            better = top > best[paths.texts]
            who = paths.texts[better]
            best[who], source[who], place[who] = top[better], i, spot[better]
        if turn == samples:
            return found, best
        texts = np.flatnonzero(best > -np.inf)
        if not len(texts):
            return found, best
        m = len(texts)
        branch, node_edge, closed, prefix_from, cut_word = (np.zeros(m, np.int64) for _ in range(5))
        closed = np.full((m, samples + 1), -1)
        heads, head_words = [None] * len(found), [None] * len(found)
        for i, paths in enumerate(found):
            rows = np.flatnonzero(source[texts] == i)
            if not len(rows):
                continue
            inner = np.searchsorted(paths.texts, texts[rows])
            at = place[texts[rows]]
            branch[rows] = at - paths.begins[inner]
            node_edge[rows] = paths.edges[at]
            cut_word[rows] = paths.words[at]
            same = paths.branch[inner] == branch[rows]
            closed[rows[same]] = paths.closed[inner[same]]
            closed[rows[~same], 0] = node_edge[rows[~same]]
            paths.bounds[at] = -np.inf
            span = ranges(paths.begins[inner], branch[rows])
            heads[i] = (rows, paths.edges[span])
            head_words[i] = paths.words[span]
        # Another edge of the node, by its chance among those that are not excluded.
        node = lattices.origin[node_edge]
        shut = np.where(closed >= 0, lattices.chance[closed], 0.0).sum(axis=1)
        goal = uniform(streams(keys[texts], 3, turn, branch)) * np.maximum(1.0 - shut, 0.0)
        edge, reached, picked = lattices.first[node].copy(), np.zeros(m), np.full(m, -1)
        for offset in range(int(lattices.degree[node].max())):
            here = edge + offset
            valid = (offset < lattices.degree[node]) & ~(closed == here[:, None]).any(axis=1)
            waiting = valid & ((picked < 0) | (reached < goal))
            picked[waiting] = here[waiting]
            reached[waiting] += lattices.chance[here[waiting]]
        slot = (closed >= 0).sum(axis=1)
        closed[np.arange(m), slot] = picked
        # The rest of the cut word, and all words behind it, are drawn anew.
        behind = sizes[texts] - cut_word - 1
        fresh_counts = 1 + behind
        fresh_begins = np.cumsum(fresh_counts) - fresh_counts
        nodes = np.empty(int(fresh_counts.sum()), np.int64)
        numbers = ranges(cut_word, fresh_counts)
        nodes[:] = starts[ranges(opens[texts] + cut_word, fresh_counts)]
        nodes[fresh_begins] = lattices.reach[picked]
        more, steps = lattices.walk(nodes, streams(np.repeat(keys[texts], fresh_counts), 1, turn, numbers))
        tail_counts = np.add.reduceat(steps, fresh_begins)
        counts = branch + 1 + tail_counts
        begins = np.cumsum(counts) - counts
        edges, words = np.empty(int(counts.sum()), np.int32), np.empty(int(counts.sum()), np.int32)
        for part, word_part in zip(heads, head_words):
            if part is not None:
                rows, taken = part
                target = ranges(begins[rows], branch[rows])
                edges[target], words[target] = taken, word_part
        edges[begins + branch], words[begins + branch] = picked, cut_word
        target = ranges(begins + branch + 1, tail_counts)
        edges[target], words[target] = more, np.repeat(numbers, steps)
        found.append(new_paths(lattices, texts, counts, edges, words, keys[texts], turn, best[texts], branch, closed))
    return found, best


def piece_ids(lattices: Lattices, paths: Paths, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of the paths and the number per path; characters beyond the vocabulary become their bytes."""
    pieces = lattices.piece[paths.edges]
    foreign = np.flatnonzero(pieces < 0)
    if not len(foreign):
        return pieces, paths.counts
    spelled = [chr(-p).encode("utf-8", "replace") for p in pieces[foreign].tolist()]
    width = np.ones(len(pieces), np.int64)
    width[foreign] = [len(b) for b in spelled]
    out = np.repeat(pieces, width)
    ends = np.cumsum(width)
    out[ranges(ends[foreign] - width[foreign], width[foreign])] = model.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    return out, np.add.reduceat(width, paths.begins)


def sample_segmentations(pages: DataFrame, vocabulary: str, samples: int = SAMPLES, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """``(uri, sample, ids, log_prob, perturbed, inclusion)``: up to ``samples`` distinct segmentations per row of ``pages(uri, content)``.

    ``sample`` counts from 0 in falling perturbed value; ``log_prob`` is the exact log-probability of the segmentation,
    ``inclusion`` the chance that a segmentation of this probability is among those drawn, given the next value
    (1 where all segmentations were drawn). Draws depend on ``seed`` and ``uri`` alone, so a repeated task repeats them;
    rows that repeat a ``uri`` repeat its draws. Null and empty text has one segmentation, the empty one. Null ``uri`` is a
    key like any other; other columns are ignored; an empty table gives an empty table. The project's pages are
    texts like any other here: nothing in this operator is particular to its records.
    """
    if samples < 1:
        raise ValueError("at least one sample is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary, sharpness)
        lattices = LatticeStore(model)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            keys = batch.column(2).to_numpy().view(np.uint64)
            for some in portions(pc.utf8_length(texts).to_pylist(), CHARACTERS_AT_ONCE):
                words = model.columns(texts[some])
                at = np.arange(some.start, some.stop)
                full = words.sizes > 0
                words.sizes = words.sizes[full]
                for i in at[~full]:
                    yield rows(batch, np.array([i]), 0, np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1), np.zeros(1), np.ones(1))
                if not full.any():
                    continue
                found, following = sampled_paths(words, keys[at[full]], lattices, samples)
                for number, paths in enumerate(found):
                    ids, counts = piece_ids(lattices, paths, model)
                    inclusion = -np.expm1(-np.exp(np.minimum(paths.log_chance - following[paths.texts], 50.0)))
                    yield rows(batch, at[full][paths.texts], number, ids.astype(np.int32), counts, paths.log_chance, paths.value, inclusion)

    def rows(batch, at, number, ids, counts, log_prob, perturbed, inclusion) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), number, np.int32)), lists, pa.array(log_prob),
                                           pa.array(perturbed), pa.array(inclusion)], ["uri", "sample", "ids", "log_prob", "perturbed", "inclusion"])

    kind = pages.schema["uri"].dataType.simpleString()
    keyed = pages.select("uri", F.col("content").cast("string").alias("content"), F.xxhash64(F.lit(seed), "uri").alias("key"))
    return keyed.mapInArrow(run, f"uri {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double")


def decode_pieces(segmentations: DataFrame, vocabulary: str) -> DataFrame:
    """``(uri, sample, content)``: the texts that ``segmentations(uri, sample, ids)`` spell; null ids give null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(vocabulary)
        for batch in batches:
            texts = [None if ids is None else model.processor.decode(ids) for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["uri", "sample", "content"])

    kind = segmentations.schema["uri"].dataType.simpleString()
    return segmentations.select("uri", "sample", "ids").mapInArrow(run, f"uri {kind}, sample int, content string")
