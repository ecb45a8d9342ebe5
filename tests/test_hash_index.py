"""Incremental-radius search against comparing everything."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions.hashes import hash_words
from sightline.operators import attribution, hash_index
from sightline.operators.attribution import closest_hashes, restore_sizes


def flipped(draw, value, bits, width=64):
    for at in draw.sample(range(width), bits):
        value ^= 1 << at
    return value


def registry(draw, n):
    values = [draw.getrandbits(64) for _ in range(n)] + [flipped(draw, 0, draw.randint(0, 6)) for _ in range(60)]
    return [(100 + i // 2 * 2 - i % 2, f"{v:016x}") for i, v in enumerate(values)] + [(5, "00ff"), (6, "00fe"), (7, None), (8, "")]


def copies_of(draw, assets, most):
    known = [int(h, 16) for _, h in assets if h and len(h) == 16]
    return [f"{flipped(draw, draw.choice(known), draw.randint(0, most)):016x}" for _ in range(150)] + [f"{draw.getrandbits(64):016x}" for _ in range(10)] + ["00f0", None, "", "abcdef"]


def plain_nearest(hashes, assets, k, below):
    firsts = {}
    for i, h in assets:
        if h:
            firsts[h] = min(i, firsts.get(h, i))
    out = {}
    for h in {h for h in hashes if h}:
        found = sorted(((int(h, 16) ^ int(a, 16)).bit_count(), i, a) for a, i in firsts.items() if len(a) == len(h))
        found = [f for f in found if (f[0] < 4 * len(h) if below is None else f[0] <= below)][:k]
        if found:
            out[h] = found
    return out


@pytest.mark.parametrize("seed,k,below,bucket,rows", [(1, 1, None, 512, 0), (2, 3, None, 5, 0), (3, 2, 12, 512, 0), (4, 5, 3, 4, 0), (2, 3, None, 5, 4096)])
def test_nearest(spark, monkeypatch, seed, k, below, bucket, rows):
    monkeypatch.setattr(hash_index, "BUCKET_ROWS", bucket)
    draw = random.Random(seed)
    assets = registry(draw, 300)
    hashes = copies_of(draw, assets, 13)
    content = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "content_id int, phash string")
    table = spark.createDataFrame(assets, "asset_id int, phash string")
    got = {r.phash: [tuple(n) for n in r.near] for r in closest_hashes(content, table, k, below, cell_rows=rows).collect()}
    assert got == plain_nearest(hashes, assets, k, below)
    empty = closest_hashes(content, table.limit(0), k, below, cell_rows=rows)
    assert empty.collect() == [] and closest_hashes(content.limit(0), table, k, below, cell_rows=rows).collect() == []


def test_few_hashes_meet_everything(spark, monkeypatch):
    draw = random.Random(9)
    assets = [(i, f"{draw.getrandbits(64):016x}") for i in range(2000)]
    hashes = [f"{flipped(draw, int(draw.choice(assets)[1], 16), draw.choice([0, 0, 1, 2, 4])):016x}" for _ in range(500)] + [f"{draw.getrandbits(64):016x}" for _ in range(25)]
    reached = []
    join = attribution.block_join
    monkeypatch.setattr(attribution, "block_join", lambda left, *rest, **more: reached.append(left.count()) or join(left, *rest, **more))
    content, table = spark.createDataFrame([(h,) for h in hashes], "phash string"), spark.createDataFrame(assets, "asset_id int, phash string")
    got = {r.phash: [tuple(n) for n in r.near] for r in closest_hashes(content, table, cell_rows=0).collect()}
    assert got == plain_nearest(hashes, assets, 1, None)
    assert sum(reached) <= 25  # only hashes that are no copies


def test_sizes(spark):
    draw = random.Random(6)
    assets = [(i, f"{draw.choice([0, draw.getrandbits(64)]):016x}", draw.choice([100, 200, 300, None]), draw.choice([100, 200, 150])) for i in range(300)]
    known = [a[1] for a in assets]
    content = [(i, f"{flipped(draw, int(draw.choice(known), 16), draw.randint(0, 14)):016x}", draw.choice([50, 100, 150]), draw.choice([50, 100])) for i in range(120)]
    got = {}
    rows = restore_sizes(spark.createDataFrame(content, "content_id int, phash string, width int, height int"), spark.createDataFrame(assets, "asset_id int, phash string, width int, height int"), cell_rows=0)
    for r in rows.orderBy("content_id", "rank").collect():
        got.setdefault(r.content_id, []).append((r.asset_width, r.asset_height))
    want = {}
    for i, h, w, t in content:
        best = {}
        for asset, a, aw, ah in assets:
            d = (int(h, 16) ^ int(a, 16)).bit_count()
            if aw is None or 1 - d / 64 < 0.8125 or (abs(w - aw) <= 0.01 * aw and abs(t - ah) <= 0.01 * ah) or abs(w / t - aw / ah) > 0.02 * (aw / ah):
                continue
            best[aw, ah] = min(best.get((aw, ah), (d, asset)), (d, asset))
        if best:
            want[i] = sorted(best, key=lambda s: (best[s], s))[:3]
    assert got == want


def test_dear_look_ups_are_left_to_the_matrix(spark, monkeypatch):
    """Hashes without near ones are compared with everything once; no round is made whose look-ups cost more than that."""
    draw = random.Random(11)
    rounds, one = [], hash_index._round
    monkeypatch.setattr(hash_index, "_round", lambda *args: rounds.append(args[5]) or one(*args))
    hashes = [f"{draw.getrandbits(64):016x}" for _ in range(40)]
    assets = [(i, f"{draw.getrandbits(64):016x}") for i in range(300)]
    content, table = spark.createDataFrame([(h,) for h in hashes], "phash string"), spark.createDataFrame(assets, "asset_id int, phash string")
    got = {r.phash: [tuple(n) for n in r.near] for r in closest_hashes(content, table, 3, cell_rows=100).collect()}
    assert got == plain_nearest(hashes, assets, 3, None) and rounds == [0, 1]


def test_sizes_of_a_block():
    """A block of 4,096 hashes against another: the nearest of each size, without a step in Python per pair."""
    draw = np.random.default_rng(3)
    frame = lambda n, size: pd.DataFrame({"phash": [str(i) for i in range(n)], "words": [np.array([v]) for v in draw.integers(0, 1 << 12, n)], "digits": 3,
                                          "width": [size(i) for i in range(n)], "height": [size(i) * 3 // 4 for i in range(n)], "first_id": draw.permutation(n)})
    left, right = frame(30, lambda i: 160), frame(400, lambda i: 200 + i % 5 * 40)
    got = {}
    for row in attribution._sizes(0.5, 3)(left, right).itertuples():
        got.setdefault(row.phash, []).append((row.distance, row.first_id, row.asset_width))
    for i, words in zip(left["phash"], left["words"]):
        best = {}
        for other, width, first in zip(right["words"], right["width"], right["first_id"]):
            near = (int(words[0] ^ other[0]).bit_count(), first, width)
            if near[0] <= 6:
                best[width] = min(best.get(width, near), near)
        assert got.get(i, []) == sorted(best.values())[:3]
    big = frame(4096, lambda i: 160), frame(4096, lambda i: 200 + i % 5 * 40)
    began = time.process_time()
    assert len(attribution._sizes(0.5, 3)(*big)) == 3 * 4096
    assert time.process_time() - began < 20  # a step per usable pair took minutes
