"""Products in single precision, settled in double: the same leaders as double precision alone, whatever the tiles."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions.boxes import make_box
from sightline.operators import attribution, blocks, hash_index, maxima
from sightline.operators.matching import _top_scores, identity_scores
from sightline.plans.images import analyze_images
from sightline.plans.videos import analyze_videos


def all_pairs(a, b, codes, wanted, barred):
    """The leading two identities of each probe and the wanted one, by double precision over all pairs."""
    unit = [maxima.unit_rows(side)[0] for side in (a, b)]
    scores = np.stack([(unit[0] * row).sum(1) for row in unit[1]], axis=1)
    squares = np.stack([((a.astype(np.float64) - row) ** 2).sum(1) for row in b.astype(np.float64)], axis=1)
    scores[barred], squares[barred] = -np.inf, np.inf
    bounds = np.flatnonzero(np.r_[True, np.diff(codes) > 0])
    level, near = np.maximum.reduceat(scores, bounds, axis=1), np.minimum.reduceat(squares, bounds, axis=1)
    out = {}
    for i, row in enumerate(level):
        for u in {*np.argsort(-row, kind="stable")[:2].tolist(), *([wanted[i]] if wanted[i] >= 0 else [])}:
            if np.isfinite(row[u]):
                out[i, u] = row[u], near[i, u]
    return out


@pytest.mark.parametrize("seed", range(8))
def test_leaders_are_those_of_double_precision(monkeypatch, seed):
    draw = np.random.default_rng(seed)
    monkeypatch.setattr(maxima, "SEGMENT", [7, 100, 512][seed % 3])
    monkeypatch.setattr(maxima, "TILE", [512, 4096][seed % 2])
    monkeypatch.setattr(maxima, "TILE_ROWS", [64, 512][seed % 2])
    monkeypatch.setattr(maxima, "USERS", [4, 4096][seed % 2])
    monkeypatch.setattr(maxima, "STRIPE", [100, 8192][seed // 2 % 2])
    users, width = [1, 2, 10, 200][seed % 4], [16, 64][seed % 2]
    codes = np.sort(np.r_[np.arange(users), draw.integers(0, users, 900)])
    a, b = draw.normal(size=(300, width)), draw.normal(size=(len(codes), width))
    if seed % 2:  # unit vectors, equal ones under several identities, and probes that are enrolled
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b[len(b) // 2:] = b[:len(b) - len(b) // 2]
        a[:100] = b[:100]
    else:  # lengths that differ, zero vectors
        a, b = (a * draw.uniform(1e-3, 3, (300, 1))).astype(np.float32), b.astype(np.float32)
        a[0], b[draw.integers(0, len(b), 3)] = 0, 0
    wanted = draw.integers(-1, users, 300)
    barred = (np.arange(0, 300, 3), draw.integers(0, len(b), 100)) if seed > 3 else (np.empty(0, int), np.empty(0, int))
    got = {(i, u): (s, d * d) for part in maxima.leaders(a, maxima.Enrolled(b, codes), wanted, barred) for i, u, s, d in zip(*[p.tolist() for p in part])}
    want = all_pairs(a, b, codes, wanted, barred)
    assert set(got) == set(want)
    assert max(max(abs(x - y) for x, y in zip(got[key], want[key])) for key in want) < 1e-11


def test_equal_vectors_score_the_same_wherever_they_lie(spark):
    """One face under two identities: the smaller id leads, though the other one's lies at the rim of a product."""
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(1501, 64)).tolist()
    rows = [(user, i, v, 64) for user, side in (("b", vectors), ("a", vectors[::-1])) for i, v in enumerate(side)]
    refs = spark.createDataFrame(rows, "user_id string, ref_ix int, vector array<float>, dim int")
    probes = refs.where("user_id = 'b'").select(F.col("ref_ix").alias("probe_id"), "vector", "dim")
    found = identity_scores(probes, refs, block_rows=1000).groupBy("probe_id").agg(F.count_distinct("similarity").alias("n"), F.count_distinct("user_id").alias("users"))
    assert found.where("n = 1 AND users = 2").count() == 1501


def test_a_batch_is_prepared_once(spark, monkeypatch):
    """Six blocks against six are a few products of whole batches, not one per pair of blocks, and no block is sorted anew for each other."""
    prepared, enrolled = spark.sparkContext.accumulator(0), maxima.Enrolled

    def counted(*args):
        prepared.add(1)
        return enrolled(*args)

    monkeypatch.setattr("sightline.operators.matching.Enrolled", counted)
    draw = np.random.default_rng(2)
    side = [(i, i % 5, draw.normal(size=8).tolist()) for i in range(600)]
    refs = spark.createDataFrame(side, "ref_ix int, user_id int, vector array<double>").withColumn("dim", F.size("vector"))
    found = blocks.block_join(refs.select(F.col("ref_ix").alias("probe_id"), "vector", "dim"), refs.withColumns({"spread": F.xxhash64("ref_ix"), "ref_name": F.lit(None).cast("int")}),
                              ["probe_id"], ["user_id", "spread"], _top_scores(1, False, True), "probe_id int, user_id int, similarity double, distance double",
                              same=["dim"], rows=10, whole=True)
    assert found.groupBy("probe_id", "user_id").agg(F.max("similarity")).groupBy("probe_id").count().where("count >= 2").count() == 600
    assert 0 < prepared.value <= 2 * 36  # 60 blocks a side were 3,600 pairs; what is grouped may be run twice


def test_wide_identities_are_met_without_a_pass_per_identity(spark, monkeypatch):
    """References of an identity that point everywhere rule nothing out: a probe travels once per batch of references, not once per identity."""
    copies, by_blocks = spark.sparkContext.accumulator(0), blocks.by_blocks

    def counted(*args):
        cell = by_blocks(*args)
        return lambda x, y: copies.add(len(x)) or cell(x, y)

    for module in ("blocks", "bounded"):
        monkeypatch.setattr(f"sightline.operators.{module}.by_blocks", counted)
    draw = np.random.default_rng(3)
    rows = [(i, i % 12, draw.normal(size=16).tolist(), 16) for i in range(720)]
    refs = spark.createDataFrame(rows, "ref_ix int, user_id int, vector array<double>, dim int")
    probes = refs.select(F.col("ref_ix").alias("probe_id"), "vector", "dim")
    scores = identity_scores(probes, refs, block_rows=60).localCheckpoint()
    assert copies.value <= 720 * 2  # one block; twelve blocks by direction were twelve copies
    plain = identity_scores(probes, refs)
    best = lambda df: {tuple(r) for r in df.groupBy("probe_id").agg(F.round(F.max("similarity"), 9), F.max_by("user_id", "similarity")).collect()}
    assert best(scores) == best(plain)


def test_missing_vectors_are_compared_with_nothing(spark):
    rows = [(i, i % 3, None if i % 5 == 0 else [float(i % 7), 1.0 + i % 3, float(i)], 3) for i in range(60)]
    refs = spark.createDataFrame(rows, "ref_ix int, user_id int, vector array<double>, dim int")
    known = refs.where("vector IS NOT NULL")
    probes = refs.select(F.col("ref_ix").alias("probe_id"), "vector", "dim")
    best = lambda scores: {tuple(r) for r in scores.groupBy("probe_id").agg(F.round(F.max("similarity"), 9), F.max_by("user_id", "similarity")).collect()}
    found = blocks.block_join(probes, refs.withColumns({"spread": F.xxhash64("ref_ix"), "ref_name": F.lit(None).cast("int")}), ["probe_id"], ["user_id", "spread"],
                              _top_scores(1, False, True), "probe_id int, user_id int, similarity double, distance double", same=["dim"], rows=20, whole=True)
    assert best(found) == best(identity_scores(probes.where("vector IS NOT NULL"), known))


def test_look_ups_dearer_than_tiles_are_not_made(spark, monkeypatch):
    """Beyond a block, a registry too small for look-ups to pay is compared by tiles alone; a floor leaves out what does not count."""
    draw = random.Random(5)
    rounds, one = [], hash_index._round
    monkeypatch.setattr(hash_index, "_round", lambda *args: rounds.append(args[5]) or one(*args))
    monkeypatch.setattr(hash_index, "BLOCK_ROWS", 100)
    assets = [(i // 2, f"{draw.getrandbits(64):016x}") for i in range(300)] + [(900, "00ff")]
    hashes = [f"{int(draw.choice(assets[:300])[1], 16) ^ (1 << draw.randrange(64)) ^ (draw.getrandbits(64) & draw.getrandbits(64) & draw.getrandbits(64)):016x}" for _ in range(80)] + ["00fe"]
    content, table = spark.createDataFrame([(h,) for h in hashes], "phash string"), spark.createDataFrame(assets, "asset_id int, phash string")
    for floor in (None, 0.75):
        got = {r.phash: [tuple(n) for n in r.near] for r in attribution.closest_hashes(content, table, 3, cell_rows=100, floor=floor).collect()}
        want = {}
        for h in set(hashes):
            firsts = {a: min(i for i, b in assets if b == a) for _, a in assets if len(a) == len(h)}
            found = sorted(((int(h, 16) ^ int(a, 16)).bit_count(), i, a) for a, i in firsts.items())
            found = [f for f in found if f[0] < 4 * len(h) and (floor is None or 1 - f[0] / (4 * len(h)) >= floor)][:3]
            want |= {h: found} if found else {}
        assert got == want
    assert rounds == []


def hashes_counted(made):
    """Makes a table count how many of its hashes are made."""
    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    return lambda df: df.withColumn("phash", seen.asNondeterministic()("phash"))


def vector(k):
    return [1.0 if i == k else 0.1 for i in range(4)]


def test_given_tables_of_a_video_are_made_once(spark):
    """Samples, detections and assets may be dear to make; what reads them several times reads what was made once."""
    made = spark.sparkContext.accumulator(0)
    once = hashes_counted(made)
    samples = spark.createDataFrame([(v, s, s / 2.0, f"{v * 7 + 1:016x}", 100) for v in range(4) for s in range(5)], "video_id bigint, step bigint, ts double, phash string, side int")
    faces = spark.createDataFrame([(v, s, 0, 0.0, 0.0, 9.0, 9.0, s / 2.0, vector(v % 3), 4, 90.0) for v in range(4) for s in range(5)],
                                  "video_id bigint, step bigint, det_ix bigint, x1 double, y1 double, x2 double, y2 double, ts double, vector array<double>, dim int, pixels double")
    assets = spark.createDataFrame([(i, f"user-{i % 3}", f"{i * 7 + 1:016x}", None, False, "d") for i in range(6)],
                                   "asset_id bigint, user_id string, phash string, watermark_code string, shielded boolean, distribution_id string")
    refs = spark.createDataFrame([(f"user-{k}", k, vector(k), 4) for k in range(3)], "user_id string, ref_ix int, vector array<double>, dim int")
    none = assets.limit(0).select(F.col("asset_id").alias("video_id"), "asset_id", F.col("watermark_code").alias("code"))
    scorer = lambda gated: gated.select("video_id", "segment", "track_id", "step", F.lit(0.5).alias("score"))
    out = analyze_videos(once(samples), faces, none, once(assets), refs, scorer).collect()
    assert {(r.video_id, r.subject_user_id, r.faces_detected) for r in out} == {(v, f"user-{v % 3}", 1) for v in range(4)}
    assert made.value == 20 + 6


def test_given_tables_of_images_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)
    once = hashes_counted(made)
    box = lambda df: df.withColumn("bbox", make_box(F.lit(1), F.lit(1), F.lit(9), F.lit(9))).withColumn("pixels", F.lit(90.0))
    content = spark.createDataFrame([(i, f"copy-{i}", None, f"{i * 7 + 1:016x}", 100, 80) for i in range(6)],
                                    "content_id bigint, sha256 string, code string, phash string, width int, height int")
    assets = spark.createDataFrame([(i, f"user-{i % 3}", f"asset-{i}", f"{i * 7 + 1:016x}", None, "d", 100, 80, False) for i in range(6)],
                                   "asset_id bigint, user_id string, sha256 string, phash string, watermark_code string, distribution_id string, width int, height int, shielded boolean")
    faces = box(spark.createDataFrame([(i, 0, vector(i % 3), 4, 1.5) for i in range(6)], "content_id bigint, face_ix int, vector array<double>, dim int, change_ratio double")).withColumn(
        "quality", F.lit(None).cast("double"))
    registered = box(spark.createDataFrame([(i, 0, vector(i % 3), 4, 100.0, 80.0, f"user-{i % 3}", False) for i in range(6)],
                                           "asset_id bigint, face_ix int, vector array<double>, dim int, width double, height double, user_id string, shielded boolean"))
    refs = spark.createDataFrame([(f"user-{k}", k, vector(k), 4) for k in range(3)], "user_id string, ref_ix int, vector array<double>, dim int")
    out = analyze_images(once(content), faces, once(assets), registered, refs).collect()
    assert {(r.content_id, r.subject_user_id, r.asset_match_basis, r.subject_decision) for r in out} == {(i, f"user-{i % 3}", "perceptual", "high_confidence") for i in range(6)}
    assert made.value == 6 + 6


def test_small_batches_have_short_segments():
    """Settling a segment costs as much as many references: a small batch has short ones, a large one long ones."""
    draw = np.random.default_rng(4)
    sizes = [maxima.Enrolled(draw.normal(size=(n, 2)), np.zeros(n, int)).segment for n in (3, 10_000, 100_000)]
    assert sizes == [128, 128, 512]
