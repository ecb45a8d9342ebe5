"""SimHash fingerprints of texts, and Hamming links between 64-bit fingerprints by pigeonring filtering.

A fingerprint is cut into five ring segments (13, 13, 13, 13, 12 bits). With at most four differing bits in
all, some start of the ring has a chain whose first one, two, three, four and five segments differ in at most
0, 1, 2, 3 and 4 bits: the budget in proportion to its length (Qin and Xiao, 2018). The first segment is the
bucket key; the longer prefixes prune the pairs of a bucket before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.base import Shelf, raw
from sightline.llm.groups import linked_groups

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_DIFFERENCE = 4
WIDTHS = [13, 13, 13, 13, 12]
OFFSETS = [0, 13, 26, 39, 52]
BUCKET_ROWS = 8192  # a larger bucket is keyed anew by a longer chain, and then by midpoints
HASHES_AT_ONCE = 1 << 16


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: the majority of each bit over the XXH64 of all its shingles; no word, zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(flat, HASH_SEED)
    starts = [0, *ends]
    total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, HASHES_AT_ONCE):
        some = min(HASHES_AT_ONCE, total - at)
        hashes = np.fromiter((digest(flat[a:b - 1], HASH_SEED) for a, b in zip(starts[at:at + some], ends[at + shingle - 1:])),
                             dtype="<u8", count=some)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def text_fingerprints(media_content: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(uri, phash BIGINT)`` of each text of ``media_content(uri, content)``; null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([text_fingerprint(t, shingle) for t in raw(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["uri", "phash"])

    kind = media_content.schema["uri"].dataType.simpleString()
    return media_content.select("uri", F.col("content").cast("string").alias("content")).mapInArrow(run, f"uri {kind}, phash bigint")


def ring_mask(start: int, segments: int) -> np.uint64:
    """Bits of ``segments`` consecutive ring segments from ``start``."""
    mask = 0
    for i in range(start, start + segments):
        mask |= ((1 << WIDTHS[i % 5]) - 1) << OFFSETS[i % 5]
    return np.uint64(mask)


MASKS = [[ring_mask(s, length) for length in range(1, 6)] for s in range(5)]


def within(one: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Positions in ``others`` that lie within the difference of ``one``, pruned chain by chain."""
    apart = others ^ one
    left = np.arange(len(others))
    for length in range(2, 6):  # the first segment is equal by the bucket's key
        budget = length * MAX_DIFFERENCE // 5
        passed = np.bitwise_count(apart & MASKS[start][length - 1]) <= budget
        left, apart = left[passed], apart[passed]
        if not len(left):
            break
    return left


def spanning_links(prints: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a bucket's fingerprints: each is reached once, none is paired with all."""
    waiting = np.arange(len(prints))
    ups, downs = [], []
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            node = frontier.pop()
            found = within(prints[node], prints[waiting], start)
            if len(found):
                reached = waiting[found]
                ups.append(np.full(len(reached), node))
                downs.append(reached)
                frontier.extend(reached)
                waiting = np.delete(waiting, found)
    if not ups:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(ups), np.concatenate(downs)


def small_bucket_links(prints: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``spanning_links``, in one matrix where the bucket is small; then most buckets hold no link at all."""
    apart = prints[:, None] ^ prints[None, :]
    near = np.bitwise_count(apart & MASKS[start][1]) <= 2 * MAX_DIFFERENCE // 5
    a, b = np.nonzero(np.triu(near, 1))
    if not len(a):
        return a, b
    near = np.bitwise_count(prints[a] ^ prints[b]) <= MAX_DIFFERENCE
    return a[near], b[near]


def bucket_links(key_bits: int):
    """A task's walk over rows sorted by bucket: links among the rows of each bucket."""
    def links_of(keys: np.ndarray, prints: np.ndarray, owners: pa.Array) -> pa.RecordBatch | None:
        bounds = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]
        ups, downs = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            start = int(keys[a] >> key_bits)
            up, down = (small_bucket_links if b - a <= 128 else spanning_links)(prints[a:b], start)
            if len(up):
                ups.append(up + a)
                downs.append(down + a)
        if not ups:
            return None
        return pa.RecordBatch.from_arrays([owners.take(pa.array(np.concatenate(ups))), owners.take(pa.array(np.concatenate(downs)))], ["a", "b"])

    def answer(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(parts).combine_chunks() if parts else None
        if whole is not None and whole.num_rows:
            out = links_of(whole.column(0).to_numpy(), whole.column(1).to_numpy().view(np.uint64), whole.column(2).combine_chunks())
            if out is not None:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            if not cut and held and held[0].column(0)[0].as_py() == int(keys[0]):
                held.append(batch)
                continue
            yield from answer([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        yield from answer(held)

    return run


def segment(start: int) -> Column:
    """A ring segment of the fingerprint as a number."""
    return F.shiftrightunsigned("phash", OFFSETS[start % 5]).bitwiseAND(F.lit((1 << WIDTHS[start % 5]) - 1))


def walked(rows: DataFrame, key_bits: int, kind: str) -> DataFrame:
    """The links inside every bucket of ``rows(key, phash, owner)``."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(bucket_links(key_bits), f"a {kind}, b {kind}")


def midpoint_masks(start: int, free: int) -> np.ndarray:
    """Every choice of at most two bits outside the equal first segment and the equal part of the second."""
    fixed = int(MASKS[start][1]) & ~(1 << (OFFSETS[(start + 1) % 5] + free))
    bits = [1 << i for i in range(64) if not fixed >> i & 1]
    ball = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]
    return np.array(ball, dtype=np.uint64)


def midpoints(rows: DataFrame, kind: str) -> DataFrame:
    """``(key, mid, owner)``: two fingerprints of a bucket within four bits share a point within two bits of both,
    and all that share such a point are within four bits of each other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            order = np.argsort(keys, kind="stable")
            for a in range(0, len(order), 64):
                for key in np.unique(keys[order[a:a + 64]]):
                    rows_at = order[a:a + 64][keys[order[a:a + 64]] == key]
                    masks = midpoint_masks(int(key) >> 30, int(key) >> 13 & 15)
                    mids = (prints[rows_at][:, None] ^ masks[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mids), key)), pa.array(mids.view(np.int64)),
                                                      batch.column(2).take(pa.array(np.repeat(rows_at, len(masks))))], ["key", "mid", "owner"])

    return rows.mapInArrow(run, f"key bigint, mid bigint, owner {kind}")


def fingerprint_links(assets: DataFrame, shelf: Shelf, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints of ``assets(owner, phash)`` to connect all that are
    within four bits, and none that is not.

    Buckets by one equal segment are compared in their tasks. A bucket above ``bucket_rows`` is keyed anew by the
    chain's second segment with one bit left free, and one that stays too large by shared midpoints, which needs
    no comparison at all: work per row stays bounded and no link is lost.
    """
    kind = assets.schema["owner"].dataType.simpleString()
    first = assets.select(F.explode(F.array(*[F.struct((F.lit(s << 13) + segment(s)).cast("bigint").alias("key")) for s in range(5)])).alias("at"),
                          "phash", "owner").select("at.key", "phash", "owner")
    sizes = shelf.keep(first.groupBy("key").count(), "sizes")
    large = sizes.where(F.col("count") > bucket_rows).select("key")  # at most 5 x 2^13 keys exist
    if large.isEmpty():
        return walked(first, 13, kind)
    links = walked(first.join(F.broadcast(large), "key", "left_anti"), 13, kind)
    second = [F.shiftleft((F.lit(s << 13) + segment(s)).cast("bigint"), 17) + F.lit(p << 13) + segment(s + 1).bitwiseAND(F.lit(~(1 << p)))
              for s in range(5) for p in range(WIDTHS[(s + 1) % 5])]
    starts = [s for s in range(5) for _ in range(WIDTHS[(s + 1) % 5])]
    hot = first.join(F.broadcast(large), "key", "left_semi").withColumn("start", F.shiftright("key", 13))
    again = hot.select(F.explode(F.filter(F.array(*[F.struct(F.lit(s).alias("start"), k.alias("key")) for s, k in zip(starts, second)]),
                                          lambda x: x["start"] == F.col("start"))).alias("at"), "phash", "owner").select("at.key", "phash", "owner")
    again = shelf.keep(again, "longer")
    sizes = shelf.keep(again.groupBy("key").count(), "sizes").withColumnRenamed("count", "n")
    fits = again.join(sizes.where(F.col("n") <= bucket_rows).select("key"), "key", "left_semi")
    links = links.unionByName(walked(fits, 30, kind))
    over = sizes.where(F.col("n") > bucket_rows).select("key")
    if over.isEmpty():
        return links
    points = shelf.keep(midpoints(again.join(over, "key", "left_semi").select("key", "phash", "owner"), kind), "midpoints")
    centres = shelf.keep(points.groupBy("key", "mid").agg(F.min("owner").alias("b")), "centres")
    return links.unionByName(points.join(centres, ["key", "mid"]).where("owner <> b").select(F.col("owner").alias("a"), "b").distinct())


def fingerprint_groups(assets: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(asset_id, phash, group)``: groups of ``assets(asset_id, phash BIGINT)`` connected by differences of at most four bits.

    ``group`` is the smallest ``asset_id`` that can be reached. Equal fingerprints are one node however many
    assets share them. A null fingerprint is linked with nothing: its group is its own ``asset_id``. Rows without
    ``asset_id`` join a group but never name it (a group of such rows only has a null name). Repeated rows share
    their group; other columns are ignored; an empty table gives an empty table.
    """
    shelf = Shelf(assets.sparkSession, "fingerprints")
    rows = shelf.keep(assets.select("asset_id", "phash"), "rows")
    nodes = shelf.keep(rows.where("phash IS NOT NULL").groupBy("phash").agg(F.min("asset_id").alias("owner")), "nodes")
    named = nodes.select("phash", F.col("phash").alias("owner"))
    links = shelf.keep(fingerprint_links(named, shelf, bucket_rows), "links")
    groups = linked_groups(links, shelf)
    placed = shelf.keep(nodes.join(groups.withColumnRenamed("id", "phash"), "phash", "left")
                        .select("phash", "owner", F.coalesce("group", "phash").alias("root")), "placed")
    names = shelf.keep(placed.groupBy("root").agg(F.min("owner").alias("group")), "names")
    of_print = shelf.keep(placed.join(names, "root").select("phash", "group"), "groups")
    return rows.join(of_print, "phash", "left").select(
        "asset_id", "phash", F.when(F.col("phash").isNull(), F.col("asset_id")).otherwise(F.col("group")).alias("group"))


def near_copies(media_content: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(uri, phash, group)``: near copies among the texts of ``media_content(uri, content)`` (see ``fingerprint_groups``).

    Null and empty texts have fingerprint zero and are linked like any other.
    """
    shelf = Shelf(media_content.sparkSession, "near-copies")
    prints = shelf.keep(text_fingerprints(media_content.select("uri", "content")), "prints")
    return fingerprint_groups(prints.withColumnRenamed("uri", "asset_id"), bucket_rows).withColumnRenamed("asset_id", "uri")
