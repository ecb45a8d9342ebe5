"""Best-fit packing of token pieces into training sequences by a configuration linear program.

Only the histogram of piece lengths matters to the program, and it has at most as many rows as a sequence has
tokens, however large the corpus. A configuration is a multiset of lengths that fits one sequence. The program
asks for the fewest configurations that cover the histogram; multiplicative weights price the lengths, a knapsack
by dynamic programming finds the configuration of greatest price, and the averaged solution is rounded down and
completed by best fit over what is left.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf
from sightline.llm.words import with_end, word_encoder
from sightline.operators.prefix import ordered_rank

CAPACITY = 4096
ROUNDS = 400
CLASSES = 96
STEP = 0.1  # share of a demand that one round may cover
RATES = (1.0, 0.3, 0.1, 0.03)  # steep prices spread the cover fast, gentle ones fit closer


def cut_pieces(pages: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``(uri, piece, start, length, ids_crc32)``: the token pieces of ``pages(uri, content)``, each at most ``capacity`` long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(ids for portion in encoder.encoded(batch.column(1)) for ids in portion.each()):
                data = with_end(ids)
                for n, begin in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[begin:begin + 4 * capacity]
                    at.append(i)
                    piece.append(n)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64())], ["uri", "piece", "start", "length", "ids_crc32"])

    kind = pages.schema["uri"].dataType.simpleString()
    return pages.select("uri", F.col("content").cast("string").alias("content")).mapInArrow(
        run, f"uri {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def dearest(lengths: np.ndarray, prices: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of greatest price, as position -> number: a knapsack by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        n = fits[room]
        values = prices[:n] + best[room - lengths[:n]]
        i = int(values.argmax())
        if values[i] > best[room - 1] + 1e-12:
            best[room], last[room] = values[i], i
        else:
            best[room] = best[room - 1]
    config: Counter[int] = Counter()
    room = capacity
    while room > 0:
        i = int(last[room])
        if i < 0:
            room -= 1
            continue
        if config[i] < limits[i]:
            config[i] += 1
        room -= int(lengths[i])
    return dict(config)


@dataclass
class Plan:
    """Configurations with the number of sequences that follow each."""

    configs: list[tuple[dict[int, int], int]]

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.configs)


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int, opened: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over a histogram and behind ``opened`` sequences: equal lengths meet equal gaps in one step."""
    gaps: dict[int, list[tuple[dict[int, int], int]]] = {}  # room left -> [(configuration, times)]
    rooms: list[int] = []

    def put(room: int, config: dict[int, int], times: int) -> None:
        if room not in gaps:
            gaps[room] = []
            bisect.insort(rooms, room)
        gaps[room].append((config, times))

    for config, times in opened:
        put(capacity - sum(n * k for n, k in config.items()), config, times)
    for length, count in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        while count > 0:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, count)
                put(capacity - each * length, {length: each}, count // each)
                count -= count // each * each
                continue
            room = rooms[at]
            config, times = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            each = min(room // length, count)
            some = min(times, count // each)
            if times > some:
                put(room, config, times - some)
            put(room - each * length, {**config, length: config.get(length, 0) + each}, some)
            count -= each * some
    return [(config, times) for held in gaps.values() for config, times in held]


def classes_of(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Class of each length: the length itself, or where there are more than ``CLASSES``, neighbours of about equal total."""
    if len(lengths) <= CLASSES:
        return np.arange(len(lengths))
    total = np.cumsum(lengths * counts)
    return np.unique(np.minimum((total - 1) * CLASSES // total[-1], CLASSES - 1), return_inverse=True)[1]


def fractional(tops: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, rate: float) -> Counter:
    """Configurations of classes with their weights: the covering program by multiplicative weights.

    A class starts at the price of its length. Each round covers a small share of the scarcest class of the dearest
    configuration, and prices fall exponentially with the share that is covered, by ``rate`` for a round's share.
    """
    share = np.zeros(len(tops))
    weights: Counter[tuple[tuple[int, int], ...]] = Counter()
    for _ in range(rounds):
        prices = tops / capacity * np.exp(-(share - share.min()) * rate / STEP)
        config = dearest(tops, prices, demand, capacity)
        step = STEP * min(demand[i] / k for i, k in config.items())
        for i, k in config.items():
            share[i] += step * k / demand[i]
        weights[tuple(sorted(config.items()))] += step
        if share.min() >= 1:
            break
    over = max(1.0, float((share * tops * demand).sum() / (tops * demand).sum()))
    return Counter({config: weight / over for config, weight in weights.items()})


def rounded_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float) -> list[tuple[dict[int, int], int]]:
    """One solution of the program, rounded down and completed."""
    left = counts.copy()
    of = classes_of(lengths, left)
    tops = np.array([lengths[of == c].max() for c in range(of.max() + 1)])
    demand = np.bincount(of, weights=left).astype(np.int64)
    waiting = [list(np.flatnonzero(of == c)) for c in range(len(tops))]  # ascending, so the longest is taken first
    opened: list[tuple[dict[int, int], int]] = []
    for config, weight in sorted(fractional(tops, demand, capacity, rounds, rate).items(), key=lambda x: -x[1]):
        times = int(weight + 1e-9)
        while (times := min([times, *(int(demand[c]) // k for c, k in config)])) > 0:
            held: Counter[int] = Counter()
            for n, (c, k) in enumerate(config):
                need = k - (n == 0)  # the last slot, of the shortest class, is filled below
                for i in reversed(waiting[c]):
                    if not need:
                        break
                    if take := min(need, int(left[i])):
                        held[int(i)] += take
                        need -= take
            # The last slot takes the longest piece that fits: classes leave room behind their members, and short pieces are worth most to the completion.
            room = capacity - sum(int(lengths[i]) * k for i, k in held.items())
            last = int(np.searchsorted(lengths, room, side="right")) - 1
            while left[last] <= held.get(last, 0):
                last -= 1
            held[last] += 1
            some = min([times, *(int(left[i]) // k for i, k in held.items())])
            for i, k in held.items():
                left[i] -= k * some
                demand[of[i]] -= k * some
            for c in {int(of[i]) for i in held}:
                while waiting[c] and not left[waiting[c][-1]]:
                    waiting[c].pop()
            opened.append(({int(lengths[i]): k for i, k in held.items()}, some))
            times -= some
    return best_fit(lengths[left > 0], left[left > 0], capacity, opened)


def configuration_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The sequences that hold every piece of ``histogram`` (length -> count).

    The program covers all lengths, in at most ``CLASSES`` classes by their longest member. Its weights are rounded
    down, each class slot takes the longest members still waiting, the last slot of a sequence the longest piece that
    fits, and best fit puts what remains into the gaps and into further sequences. The answer is the best of the
    plans by ``RATES``; the number of rounds bears on the quality only.
    """
    if not histogram:
        return Plan([])
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    plans = [rounded_plan(lengths, counts, capacity, rounds, rate) for rate in RATES]
    return Plan(min(plans, key=lambda plan: sum(times for _, times in plan)))


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank, first sequence, pieces per sequence and first place of each run of sequences."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for config, times in plan.configs:
        place = 0
        for length, each in sorted(config.items(), reverse=True):
            out.setdefault(length, []).append((taken[length], sequence, each, place))
            taken[length] += each * times
            place += each * length
        sequence += times
    return {length: tuple(np.array(c) for c in zip(*rows)) for length, rows in out.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces(uri, piece, start, length, ids_crc32)``.

    Pieces of one length are alike, so each gets its rank among them (in ranges, never one task per length) and
    the plan turns ranks into sequences. The plan holds a few rows per configuration, no row per sequence.
    """
    shelf = Shelf(pieces.sparkSession, "packing")
    kept = shelf.keep(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = pieces.sparkSession.sparkContext.broadcast(slots(configuration_plan(histogram, capacity)))
    order = [F.col("uri"), F.col("piece"), F.col("start"), F.col("ids_crc32")]
    ranked = ordered_rank(kept, ["length"], order, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy() - 1
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, base, each, place = table.value[int(n)]
                at = np.searchsorted(first, rank[rows], side="right") - 1
                turn = rank[rows] - first[at]
                sequence[rows] = base[at] + turn // each[at]
                offset[rows] = place[at] + turn % each[at] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             ["uri", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["uri"].dataType.simpleString()
    return ranked.select("uri", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"uri {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed_sequences(pages: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``(uri, piece, start, length, ids_crc32, sequence_id, offset)``: every token of ``pages(uri, content)`` in sequences of at most ``capacity``.

    A page's tokens are its ids and an end id; only pages longer than a sequence are cut, into pieces of
    ``capacity`` and a rest. Null content is empty: one piece with the end id. Repeated rows are packed each for
    itself, null ``uri`` too; other columns are ignored; an empty table gives an empty table.
    """
    return pack_pieces(cut_pieces(pages.select("uri", "content"), vocabulary, capacity), capacity)
