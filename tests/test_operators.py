"""Situations the semantics hinge on, on tiny literal frames; sequential operators against brute force."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.functions import boxes as B
from sightline.functions import codes, hashes, intervals, quality
from sightline.functions import urls as U
from sightline.functions import vectors as V
from sightline.operators import attribution as A
from sightline.operators import blocks
from sightline.operators import calibration as C
from sightline.operators import evaluation as E
from sightline.operators import lineage as L
from sightline.operators import marks as K
from sightline.operators import matching as M
from sightline.operators import planes as P
from sightline.operators import prefix
from sightline.operators import sequences as S
from sightline.settings import FaceThresholds, SamplingRules, TrackingRules


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


# --- vectors, hashes, boxes, quality, URLs, codes -------------------------------------------------

def test_vectors(spark):
    assert value(spark, V.cosine_similarity(vec(3, 4), vec(3, 4))) == pytest.approx(1.0)
    assert value(spark, V.l2_normalize(vec(0, 0))) == [0.0, 0.0]
    a, b, c, d = np.random.default_rng(1).normal(size=(4, 8))
    fused = V.cosine_similarity(V.fuse_embeddings(vec(*a), vec(*c)), V.fuse_embeddings(vec(*b), vec(*d)))
    cos = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert value(spark, fused) == pytest.approx((cos(a, b) + cos(c, d)) / 2)
    assert value(spark, V.euclidean_distance(vec(0, 0), vec(3, 4))) == 5.0
    assert value(spark, V.histogram_intersection(vec(0.5, 0.5), F.lit(None).cast("array<double>"))) == 1.0
    flipped = np.array(value(spark, V.flip_average(vec(1, 0), vec(0, 1))))
    assert np.linalg.norm(flipped) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        V.fuse_embeddings(vec(1))
    import hashlib
    expected = hashlib.sha256(b"0.500000,-1.250000").hexdigest()[:12]
    assert value(spark, V.embedding_digest(vec(0.5, -1.25))) == expected
    z = (0.5 - 0.2) / 2.0 * 1.5 + 0.1
    assert value(spark, V.logistic_score(vec(0.5), [0.2], [2.0], [1.5], 0.1)) == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("strategy,expected", [("max", 0.9), ("mean", 0.6), ("topk_mean", 0.7)])
def test_aggregation(spark, strategy, expected):
    assert value(spark, V.aggregate_similarity(vec(0.3, 0.9, 0.5, 0.7), strategy, 3)) == pytest.approx(expected)


def test_hamming(spark):
    h = lambda s: F.lit(s)
    assert value(spark, hashes.hamming(h("ffffffffffffffff"), h("0000000000000000"))) == 64
    assert value(spark, hashes.hamming(h("8000000000000001"), h("0000000000000000"))) == 2
    long = "f" * 16 + "0" * 16
    assert value(spark, hashes.hamming(h(long), h("0" * 32), 32)) == 64
    assert value(spark, hashes.hash_similarity(h(""), h(""))) == 0.0
    with pytest.raises(Exception, match="hash lengths differ"):
        value(spark, hashes.hamming(h("ff"), h("f")))


def test_plane_hashes(spark):
    rng = np.random.default_rng(2)
    plane = rng.normal(size=(8, 8))
    basis = np.array(hashes.dct_basis(8))
    low = basis @ plane @ basis.T
    bits = (low > np.median(low[1:, 1:])).ravel()
    assert value(spark, hashes.perceptual_hash(vec(*plane.ravel()))) == np.packbits(bits).tobytes().hex()
    bits = (plane > plane.mean()).ravel()
    assert value(spark, hashes.average_hash(vec(*plane.ravel()))) == np.packbits(bits).tobytes().hex()
    wide = rng.normal(size=(8, 9))
    bits = (wide[:, 1:] > wide[:, :-1]).ravel()
    assert value(spark, hashes.difference_hash(vec(*wide.ravel()))) == np.packbits(bits).tobytes().hex()


def test_boxes(spark):
    box = lambda *v: B.make_box(*[F.lit(x) for x in v])
    assert value(spark, B.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(1 / 3)
    assert value(spark, B.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert value(spark, B.box_width(box(5, 0, 3, 1))) == 0.0
    assert tuple(value(spark, B.margin_crop(box(10, 10, 20, 20), 0.25, F.lit(100.0), F.lit(21.0)))) == (8.0, 8.0, 22.0, 21.0)
    assert not value(spark, B.is_plausible(box(0, 0, 60, 60), F.lit(0.65), F.lit(100.0), F.lit(100.0)))
    assert value(spark, B.is_plausible(box(0, 0, 60, 60), F.lit(0.75), F.lit(100.0), F.lit(100.0)))
    marks = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 10, 4, 0, 0)])
    assert value(spark, B.frontality(marks)) == pytest.approx(0.8)
    assert value(spark, B.frontality(F.lit(None).cast("array<struct<x:double,y:double>>"))) == 0.5


def test_quality(spark):
    assert value(spark, quality.face_quality(F.lit(56.0), F.lit(500.0))) == 0.5
    assert value(spark, quality.is_small_face(F.lit(None).cast("double"))) is False
    limits = FaceThresholds(quality_penalty=0.2)
    assert value(spark, quality.effective_thresholds(F.lit(0.5), limits)[1]) == pytest.approx(0.57)
    assert value(spark, quality.effective_thresholds(F.lit(None).cast("double"), limits)[1]) == 0.47
    assert value(spark, quality.operating_points(F.lit(0.6)))["high"] == pytest.approx(0.8)
    assert value(spark, quality.operating_points(F.lit(1.0))) is None


def test_urls(spark):
    assert value(spark, U.url_normalise(F.lit("HTTP://A.b/c#d"))) == "HTTP://A.b/c"
    assert value(spark, U.url_normalise(F.lit("ftp://a/b"))) is None
    assert value(spark, U.url_origin(F.lit("HTTPS://A.b:8/c?d"))) == "https://a.b:8"
    kind = lambda u, m: value(spark, U.media_kind(F.lit(u), F.lit(m)))
    assert kind("http://a/x.jpg", "text/html") is None and kind("http://a/x", "image/png; q=1") == "image"
    assert kind("http://a/x.mp4", "application/octet-stream") == "video" and kind("http://a/x.gif", None) == "image"


def test_codes(spark):
    bits = value(spark, codes.message_bits(F.lit("0badcafe")))
    assert len(bits) == 64
    assert int("".join(map(str, bits[:32])), 2) == 0x0BADCAFE
    assert int("".join(map(str, bits[32:])), 2) == zlib.crc32(bytes.fromhex("0badcafe"))
    flipped = [1 - bits[0], *bits[1:]]
    as_array = lambda bs: F.array(*[F.lit(b) for b in bs])
    assert value(spark, codes.crc_valid(as_array(bits))) and not value(spark, codes.crc_valid(as_array(flipped)))
    frame = spark.createDataFrame([("u", "a", "web"), ("u", "a", None), ("v", "a", "web")], "user_id string, asset_id string, distribution_id string")
    issued = [r["watermark_code"] for r in codes.issue_codes(frame).collect()]
    assert len(set(issued)) == 3 and all(len(c) == 8 for c in issued)


# --- matching --------------------------------------------------------------------------------------

def _identities(spark, rng, people=5, photos=4, dim=8):
    rows = [(p * photos + i, p, [float(x) for x in rng.normal(size=dim)]) for p in range(people) for i in range(photos)]
    return rows, spark.createDataFrame(rows, "name int, identity int, vector array<float>")


@pytest.mark.parametrize("strategy", ["max", "topk_mean"])
@pytest.mark.parametrize("rows_per_block", [3, 4096])
def test_matching_over_many_blocks(spark, monkeypatch, strategy, rows_per_block):
    """Blocks smaller than an identity give the same decisions as one block."""
    monkeypatch.setattr(blocks.block_join, "__defaults__", ((), rows_per_block, None))
    rows, photos = _identities(spark, np.random.default_rng(3))
    probes = photos.select(F.col("name").alias("probe_id"), "vector", F.size("vector").alias("dim"))
    refs = photos.select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"), F.col("name").alias("ref_name"), "vector", F.size("vector").alias("dim"))
    got = {r["probe_id"]: r for r in M.rank_identities(M.identity_scores(probes, refs, strategy, 2, exclude_self=True)).collect()}
    unit = {n: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for n, _, v in rows}
    for name, _, _ in rows:
        scores = {}
        for other, person, _ in rows:
            if other != name:
                scores.setdefault(person, []).append(unit[name] @ unit[other])
        best = {p: np.mean(sorted(s)[-(1 if strategy == "max" else 2):]) for p, s in scores.items()}
        order = sorted(best, key=lambda p: -best[p])
        assert got[name]["user_id"] == order[0]
        assert got[name]["similarity"] == pytest.approx(best[order[0]])
        assert got[name]["runner_up"] == pytest.approx(best[order[1]])


def test_distribution_over_many_blocks(spark, monkeypatch):
    rows, photos = _identities(spark, np.random.default_rng(4), people=3, photos=5)
    whole = {tuple(r) for r in M.identity_score_counts(photos, 3).collect()}
    pairs = {tuple(r) for r in M.pair_score_counts(photos, 3).collect()}
    monkeypatch.setattr(blocks.block_join, "__defaults__", ((), 4, None))
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)  # every identity is now too large for a block
    assert {tuple(r) for r in M.identity_score_counts(photos, 3).collect()} == whole
    assert {tuple(r) for r in M.pair_score_counts(photos, 3).collect()} == pairs
    assert sum(r[2] for r in pairs) == 15 * 14 // 2


def test_margin_demotion(spark):
    scores = spark.createDataFrame([(1, "a", 0.60, 0.1), (1, "b", 0.57, 0.1), (2, "a", 0.75, 0.1), (2, "b", 0.70, 0.1), (3, "a", 0.6, 0.1),
                                    (4, "a", 0.40, 0.1), (4, "b", 0.1, 0.1), (5, "a", 0.2, 0.1), (5, "b", 0.19, 0.1)],
                                   "probe_id int, user_id string, similarity double, euclidean double")
    got = {r["probe_id"]: r for r in M.rank_identities(scores).collect()}
    assert got[1]["decision"] == "ambiguous" and got[1]["is_candidate"] and not got[1]["is_high"]
    assert got[2]["decision"] == "high_confidence"  # the margin test is strict
    assert got[3]["margin"] is None and got[3]["decision"] == "high_confidence"
    assert got[4]["decision"] == "candidate" and got[5]["decision"] == "no_match"


def test_other_dimension_is_not_compared(spark):
    refs = spark.createDataFrame([("a", 0, [1.0, 0.0], 2), ("b", 0, [1.0, 0.0, 0.0], 3)], "user_id string, ref_ix int, vector array<float>, dim int")
    probes = spark.createDataFrame([(1, [1.0, 0.0], 2)], "probe_id int, vector array<float>, dim int")
    assert M.match_probes(probes, refs).collect()[0]["user_id"] == "a"
    assert M.skipped_identities(probes, refs).first()["skipped"] == 1


def test_fused_scores_must_align(spark):
    a = spark.createDataFrame([(1, 1, 0.5, 1)], "probe_id int, user_id int, score double, label int")
    b = spark.createDataFrame([(1, 2, 0.5, 1)], "probe_id int, user_id int, score double, label int")
    with pytest.raises(Exception, match="not aligned"):
        M.fuse_scores(a, b).collect()


def test_enrollment_reasons(spark):
    rows = [("u", i, i, True, 0.9, 100, 200.0) for i in range(4)] + [("u", 4, 4, True, 0.9, 100, 101.0), ("u", 5, 5, False, None, None, None),
            ("u", 6, 6, True, 0.5, 100, 300.0), ("u", 7, 7, True, 0.9, 10, 300.0), ("u", 8, 8, True, 0.9, 100, 5.0), ("u", 9, 9, True, None, None, None),
            ("u", 10, 10, True, 0.9, 100, 900.0), ("v", 0, 0, True, 0.9, 100, 200.0)]
    frame = spark.createDataFrame(rows, "user_id string, ord int, image_id int, readable boolean, confidence double, face_pixels int, sharpness double")
    got = {(r["user_id"], r["ord"]): r for r in M.filter_enrollment(frame).collect()}
    assert ("u", 10) not in got  # beyond the first ten
    assert [got["u", i]["reason"] for i in range(5, 10)] == ["unreadable", "low_confidence", "small_face", "blurred", "no_face"]
    assert got["u", 0]["enrolled"] and not got["v", 0]["enrolled"]


# --- calibration -----------------------------------------------------------------------------------

def _reference_curve(scores, labels):
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    p, n = sum(labels), len(labels) - sum(labels)
    tpr, fpr, tp, fp = [0.0], [0.0], 0, 0
    for i in order:
        tp, fp = tp + labels[i], fp + 1 - labels[i]
        tpr.append(tp / p)
        fpr.append(fp / n)
    return tpr, fpr, sum((fpr[i] - fpr[i - 1]) * (tpr[i] + tpr[i - 1]) / 2 for i in range(1, len(tpr)))


def test_roc_keeps_tie_order(spark):
    rng = random.Random(5)
    scores, labels = [rng.randrange(6) / 5 for _ in range(40)], [rng.randrange(2) for _ in range(40)]
    frame = spark.createDataFrame([("g", i, s, y) for i, (s, y) in enumerate(zip(scores, labels))], "g string, ord int, score double, label int")
    points = C.roc_points(frame, ["g"], "ord")
    tpr, fpr, auc = _reference_curve(scores, labels)
    got = sorted(C.with_origin(points, ["g"]).collect(), key=lambda r: r["point"])
    assert [r["tpr"] for r in got] == pytest.approx(tpr) and [r["fpr"] for r in got] == pytest.approx(fpr)
    assert C.auc_eer(points, ["g"]).first()["auc"] == pytest.approx(auc)
    wins = [(a > b) + (a == b) / 2 for a, y in zip(scores, labels) if y for b, z in zip(scores, labels) if not z]
    assert C.rank_auc(frame, ["g"]).first()["auc"] == pytest.approx(sum(wins) / len(wins))


def test_one_class_has_no_curve(spark):
    frame = spark.createDataFrame([("g", 1, 0.5, 1)], "g string, ord int, score double, label int")
    assert C.roc_points(frame, ["g"], "ord").count() == 0


def test_separable_margin(spark):
    frame = spark.createDataFrame([("g", i, s, y) for i, (s, y) in enumerate([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)])], "g string, ord int, score double, label int")
    got = {r["criterion"]: r for r in C.calibrate(C.roc_points(frame, ["g"], "ord"), ["g"], 0.01, independent_pairs=5).collect()}
    assert got["max_margin"]["threshold"] == pytest.approx(0.5) and got["eer"]["threshold"] == 0.8
    assert len(got["eer"]["notes"]) == 2 and "separable" in got["max_margin"]["notes"][0]


def test_exact_bound():
    got = intervals.upper_bounds([0, 5, 7, 1, 499_999], [100, 100, 7, 10**6, 10**6], 0.95)
    assert got[:3] == pytest.approx([1 - 0.025 ** 0.01, 0.112835, 1.0], abs=1e-5)
    assert got[3] == pytest.approx(5.5716e-6, rel=1e-3) and got[4] == pytest.approx(0.50098, abs=1e-4)
    assert intervals.upper_bounds([3], [50], 0.95)[0] == pytest.approx(0.16548, abs=1e-5)
    with pytest.raises(ValueError):
        intervals.upper_bounds([3], [2], 0.95)


def test_bound_column(spark):
    frame = spark.createDataFrame([(0, 50), (3, 50), (50, 50)], "k long, n long")
    got = [r["u"] for r in frame.select(intervals.clopper_pearson_upper(F.col("k"), F.col("n")).alias("u")).collect()]
    assert got == pytest.approx(intervals.upper_bounds([0, 3, 50], [50] * 3, 0.95))


def test_quantiles_interpolate(spark):
    data = [1.0, 2.0, 2.0, 5.0, 9.0]
    frame = spark.createDataFrame([("g", x, 1) for x in data], "g string, score double, n long")
    got = C.weighted_quantiles(frame, ["g"], {"a": 0.3, "b": 0.95}).first()
    assert got["a"] == pytest.approx(np.quantile(data, 0.3)) and got["b"] == pytest.approx(np.quantile(data, 0.95))


def test_running_sums_cut_hot_groups(spark):
    frame = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), "id", (F.col("id") % 7).alias("x"))
    got = prefix.running_sums(frame, ["g"], [F.col("id").asc()], {"up": "x"}, {"all": "up"}, partitions=6).toPandas().sort_values("id")
    expected = got.groupby("g")["x"].cumsum()
    assert (got["up"] == expected).all() and (got["all"] == got.groupby("g")["x"].transform("sum")).all()


# --- attribution and lineage -----------------------------------------------------------------------

def test_attribution_order(spark):
    assets = spark.createDataFrame([("a1", "u", "s1", "0" * 16, "000000aa", "c"), ("a2", "u", "s2", "f" * 16, None, "c"), ("a3", "v", "s1", "00000000ffffffff", None, "c")],
                                   "asset_id string, user_id string, sha256 string, phash string, watermark_code string, distribution_id string")
    content = spark.createDataFrame([(1, "s1", None, "f" * 16), (2, "x", "000000aa", "f" * 16), (3, "x", None, "f" * 13 + "000"), (4, "x", None, "f" * 12 + "0007"),
                                     (5, "x", None, "ff"), (6, "s2", None, "0" * 16)], "content_id int, sha256 string, code string, phash string")
    got = {r["content_id"]: r for r in A.attribute_source(content, assets).collect()}
    assert (got[1]["asset_id"], got[1]["basis"]) == ("a1", "exact")
    assert (got[2]["asset_id"], got[2]["basis"]) == ("a1", "code")
    assert (got[3]["asset_id"], got[3]["basis"], got[3]["perceptual_similarity"]) == ("a2", "perceptual", 0.8125)  # distance 12
    assert got[4]["basis"] is None and got[4]["perceptual_similarity"] == pytest.approx(1 - 13 / 64)
    assert got[5]["basis"] is None and got[5]["perceptual_similarity"] == 0.0  # another hash length
    empty = A.attribute_source(content, assets.limit(0)).where("content_id = 3").first()
    assert empty["perceptual_similarity"] is None


def test_every_bit_different_never_matches(spark):
    assets = spark.createDataFrame([("a", "u", "s", "f" * 16, None, None)], "asset_id string, user_id string, sha256 string, phash string, watermark_code string, distribution_id string")
    content = spark.createDataFrame([(1, "x", None, "0" * 16)], "content_id int, sha256 string, code string, phash string")
    assert A.join_perceptual(content, assets).first()["by_hash"] is None


def test_lineage_cycles_and_chains(spark):
    nodes = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "gone")], "asset_id string, parent_asset string")
    got = {r["asset_id"]: (r["root"], r["depth"]) for r in L.lineage_roots(nodes).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "z": (None, None), "o": ("o", 0)}
    chain = lambda s: [r["asset_id"] for r in L.lineage_chain(nodes, spark.createDataFrame([(s,)], "asset_id string")).orderBy("depth").collect()]
    assert chain("c") == ["c", "b", "a"] and chain("z") == ["z", "x", "y"]


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    frame = spark.createDataFrame(pairs, "a int, b int")
    assert {r["id"]: r["group"] for r in L.identity_groups(frame).collect()} == {x: find(x) for x in list(parent)}


# --- sequences -------------------------------------------------------------------------------------

def test_uniform_stride(spark):
    videos = spark.createDataFrame([("short", 30.0, 90), ("long", 30.0, 90000), ("nofps", 0.0, 60), ("unknown", 30.0, 0)], "video_id string, fps double, frame_count long")
    got = {r["video_id"]: r["s"] for r in videos.select("video_id", S.sampling_stride(F.col("fps"), F.col("frame_count")).alias("s")).collect()}
    assert got == {"short": 15, "long": 150, "nofps": 12, "unknown": 15}


@pytest.mark.parametrize("chunk", [7, 4096])
def test_scene_change_matches_fold(spark, chunk):
    rng = random.Random(7)
    rows = [(v, f, [rng.random() * 40, rng.random() * 40]) for v in range(3) for f in range(90)] + [(9, f, [0.0, 0.0]) for f in range(30)]
    expected = set()
    for v in {r[0] for r in rows}:
        last = None
        for _, f, p in sorted(r for r in rows if r[0] == v):
            if last is None or np.mean(np.abs(np.array(p) - np.array(last))) >= 12.0:
                expected.add((v, f))
                last = p
    frames = spark.createDataFrame(rows, "video_id int, frame_number long, plane array<double>")
    got = {(r["video_id"], r["frame_number"]) for r in S.sample_scene_change(frames, SamplingRules(), chunk).collect()}
    assert got == expected


def _brute_tracks(dets, rules):
    """Plain per-video association by step."""
    out, tracks, next_id = {}, [], 0
    for step in sorted({d[0] for d in dets}):
        now = [d for d in dets if d[0] == step]
        tracks = [t for t in tracks if step - t["seen"] <= rules.max_gap]
        free = list(now)
        for t in tracks:
            scored = [(S._iou(t["box"], d[2]), d) for d in free]
            scored = [x for x in scored if x[0] >= rules.iou]
            if scored:
                top = max(x[0] for x in scored)
                d = next(x[1] for x in scored if x[0] == top)
                free.remove(d)
                t.update(box=d[2], seen=step)
                out[step, d[1]] = t["id"]
        for d in free:
            tracks.append({"id": next_id, "box": d[2], "seen": step})
            out[step, d[1]] = next_id
            next_id += 1
    return out


def test_tracks_match_fold(spark):
    rng = random.Random(8)
    dets = []
    for step in [*range(30), *range(40, 60), 61]:
        for ix in range(rng.randrange(4)):
            x = ix * 40 + rng.randrange(12)
            dets.append((step, ix, (float(x), 0.0, x + 30.0, 30.0)))
    frame = spark.createDataFrame([("v", s, i, *b) for s, i, b in dets], "video_id string, step long, det_ix long, x1 double, y1 double, x2 double, y2 double")
    rules = TrackingRules()
    got = S.track_faces(frame, rules).collect()
    expected = _brute_tracks(dets, rules)
    names = {}
    for r in got:
        names.setdefault((r["segment"], r["track_id"]), set()).add(expected[r["step"], r["det_ix"]])
    assert len(got) == len(dets) and all(len(v) == 1 for v in names.values())
    assert len({next(iter(v)) for v in names.values()}) == len(names)


def test_appearance_splits_tracks(spark):
    rows = [("v", 0, 0, 0.0, 0.0, 9.0, 9.0, [1.0, 0.0]), ("v", 1, 0, 0.0, 0.0, 9.0, 9.0, [0.0, 1.0]), ("w", 0, 0, 0.0, 0.0, 9.0, 9.0, None), ("w", 1, 0, 0.0, 0.0, 9.0, 9.0, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "video_id string, step long, det_ix long, x1 double, y1 double, x2 double, y2 double, descriptor array<double>")
    got = S.track_faces(frame).groupBy("video_id").agg(F.count_distinct("track_id").alias("n")).collect()
    assert {r["video_id"]: r["n"] for r in got} == {"v": 2, "w": 1}


@pytest.mark.parametrize("n", [1, 4, 5, 20, 37])
def test_trimmed_mean(spark, n):
    data = [float((i * 7) % 5) for i in range(n)]
    cut = 0 if n < 5 else max(1, int(n * 0.1))
    expected = np.mean(sorted(data)[cut:n - cut])
    frame = spark.createDataFrame([("v", x) for x in data], "v string, score double")
    assert S.aggregate_frames(frame, ["v"]).first()["score"] == pytest.approx(expected)


def test_spread(spark):
    for total, count in [(0, 3), (2, 5), (10, 3), (100, 7)]:
        got = value(spark, S.spread_indices(F.lit(total), F.lit(count)))
        if total <= count:
            assert got == list(range(total))
        else:
            assert got == sorted({int(round(i)) for i in np.linspace(0, total - 1, count + 2)[1:-1]})


# --- planes and marks ------------------------------------------------------------------------------

def test_psnr_and_ssim_of_equal_and_tiny(spark):
    rows = [("same", y, x, 8, 8, float(x * y), float(x * y)) for y in range(8) for x in range(8)] + [("tiny", y, x, 2, 2, 1.0, float(x)) for y in range(2) for x in range(2)]
    frame = spark.createDataFrame(rows, "pair_id string, y int, x int, h int, w int, a double, b double")
    assert {r["pair_id"]: r["ssim"] for r in P.ssim(frame).collect()} == {"same": pytest.approx(1.0), "tiny": 0.0}
    assert {r["pair_id"]: r["psnr"] for r in P.psnr(frame).collect()}["same"] == float("inf")


def _noisy_bits(code, wrong):
    word = f"{code:032b}" + f"{zlib.crc32(code.to_bytes(4, 'big')):032b}"
    return [(0.52 if c == "0" else 0.48) if i in wrong else (0.9 if c == "1" else 0.1) for i, c in enumerate(word)]


def test_chase_decoding(spark):
    cases = {"clean": ([], True, 0), "one": ([5], True, 1), "three": ([1, 33, 60], True, 3), "five": ([1, 2, 3, 4, 5], False, None)}
    rows = [(name, i, r) for name, (wrong, _, _) in cases.items() for i, r in enumerate(_noisy_bits(0xDEADBEEF, wrong))]
    frame = spark.createDataFrame(rows, "image_id string, bit int, ratio double")
    got = {r["image_id"]: r for r in K.detect_marks(frame, width=4).collect()}
    for name, (_, detected, flips) in cases.items():
        assert got[name]["detected"] == detected and got[name]["flips"] == flips
        assert got[name]["code"] == ("deadbeef" if detected else None)
    assert got["one"]["confidence"] < got["clean"]["confidence"]


def test_two_valid_codes_are_no_detection(spark):
    rows = []
    for image, grids in {"one": [0xCAFE0001, 0xCAFE0001], "two": [0xCAFE0001, 0xCAFE0002], "weak": [0xCAFE0001]}.items():
        for grid, code in enumerate(grids):
            rows += [(image, grid, 0, i, r, 0.1 if image == "weak" else 0.6) for i, r in enumerate(_noisy_bits(code, []))]
    frame = spark.createDataFrame(rows, "image_id string, grid int, phase int, bit int, ratio double, grid_confidence double")
    got = {r["image_id"]: r for r in K.decode_candidates(frame).collect()}
    assert got["one"]["detected"] and got["one"]["code"] == "cafe0001"
    assert not got["two"]["detected"] and got["two"]["valid_codes"] == 2 and not got["weak"]["detected"]


def test_shifted_tile_reads_under_its_phase(spark):
    code, shift = 0x0BADF00D, (3, 5)
    word = f"{code:032b}" + f"{zlib.crc32(code.to_bytes(4, 'big')):032b}"
    rows = [("i", r, c, 0, 1.0 if word[((r + shift[0]) % 8) * 8 + (c + shift[1]) % 8] == "1" else -1.0) for r in range(16) for c in range(16)]
    blocks_ = spark.createDataFrame(rows, "image_id string, row int, col int, carrier int, reading double")
    tally = K.phase_tally(blocks_, K.plain_schedule(spark))
    found = K.chase_decode(tally, ["image_id", "phase"], 0).collect()
    assert [(r["phase"], r["code"]) for r in found] == [(shift[0] * 8 + shift[1], "0badf00d")]


def test_small_pictures_carry_no_mark(spark):
    rows = [("small", r, c, 0.0, 0.0) for r in range(10) for c in range(10)]
    frame = spark.createDataFrame(rows, "image_id string, row int, col int, first double, second double")
    payload = spark.createDataFrame([("small", "0badf00d")], "image_id string, code string")
    got = K.mark_blocks(frame, payload, K.plain_schedule(spark), 8.0)
    assert got.where("first <> 0 OR second <> 0").count() == 0 and got.where("reason IS NULL").count() == 0


# --- evaluation ------------------------------------------------------------------------------------

def test_split_half_is_disjoint(spark):
    items = spark.createDataFrame([(i, [f"p{i % 10}", f"p{(i * 3) % 10}"]) for i in range(40)], "item int, people array<string>")
    sides = {r["person"]: r["calibrates"] for r in E.split_people(items.select(F.explode("people").alias("person")), 0.5, 1).collect()}
    assert sum(sides.values()) == 5
    for r in E.split_half(items, 0.5, 1).collect():
        flags = {sides[p] for p in r["people"]}
        assert r["half"] == ("split" if len(flags) > 1 else "calibration" if flags == {True} else "test")


def test_gate_reasons(spark):
    report = spark.createDataFrame([("good", "clean", 0.005), ("loose", "clean", 0.02), ("blind", "clean", None)], "detector string, degradation string, upper_95 double")
    families = spark.createDataFrame([("good", "f", "clean", 0.9), ("loose", "f", "clean", 0.9), ("blind", "f", "clean", 0.1)], "detector string, family string, degradation string, recall double")
    leaked = spark.createDataFrame([("loose",)], "detector string")
    got = {r["detector"]: r for r in E.detector_gate(report, families, leaked).collect()}
    assert got["good"]["passes"] and len(got["loose"]["reasons"]) == 2 and len(got["blind"]["reasons"]) == 2


@pytest.mark.parametrize("seed,n,m,span,grid,tolerance", [(9, 60, 90, 60, 0, 2.0), (1, 80, 40, 9, 4, 1.0), (2, 50, 70, 400, 2, 3.5), (3, 60, 60, 5, 1, 0.0), (4, 120, 100, 8, 10, 0.3)])
def test_controls_are_one_to_one_and_maximal(spark, seed, n, m, span, grid, tolerance):
    rng = random.Random(seed)
    value = lambda: 7.0 if rng.random() < 0.3 else (rng.random() * 2 - 1) * span if not grid else round((rng.random() * 2 - 1) * span * grid) / grid
    make = lambda count, base: [(base + i, f"s{rng.randrange(2)}", value()) for i in range(count)]
    targets, pool = make(n, 0) + [(900, None, 1.0), (901, "s0", None)], make(m, 1000) + [(1900, None, 1.0), (1901, "s0", None)]
    schema = "id long, stratum string, attribute double"
    got = E.match_controls(spark.createDataFrame(targets, schema), spark.createDataFrame(pool, schema), tolerance).collect()
    t, p = {x[0]: x for x in targets}, {x[0]: x for x in pool}
    close = [r for r in got if not r["fallback"]]
    assert len({r["target"] for r in got}) == len(got) == len({r["control"] for r in got}) == min(n, m) + 2
    assert all(t[r["target"]][1] == p[r["control"]][1] and abs(t[r["target"]][2] - p[r["control"]][2]) <= tolerance for r in close)
    left_t, left_p = set(t) - {r["target"] for r in close} - {900, 901}, set(p) - {r["control"] for r in close} - {1900, 1901}
    assert not [1 for a in left_t for b in left_p if t[a][1] == p[b][1] and abs(t[a][2] - p[b][2]) <= tolerance]


def test_a_crowded_attribute_is_many_tasks(spark):
    rows = spark.range(20000).select(F.col("id"), F.lit("s").alias("stratum"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 997 / 10.0).alias("attribute"))
    cut = []
    keep = prefix.cut_lineage
    prefix.cut_lineage = lambda df: cut.append(keep(df)) or cut[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these ranges are small enough to be merged
    try:
        pairs = E.match_controls(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 1.0)
        assert pairs.count() == 10000 and len(cut) == 4  # ranks, two borders, fallback: whatever the data
    finally:
        prefix.cut_lineage = keep
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut[0].groupBy("__range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 8000


def test_running_balance_and_previous(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), i, int(g := rng.random() < 0.5), int(not g)) for i in range(300)]
    got = {r["i"]: r for r in prefix.running_balance(spark.createDataFrame(rows, "k string, i int, g int, l int"), ["k"], [F.col("i")], "g", "l").collect()}
    back = {r["i"]: r["before"] for r in prefix.previous(spark.createDataFrame(rows, "k string, i int, g int, l int"), ["k"], [F.col("i")], ["i"], "before").collect()}
    for key in "ab":
        gains = losses = missed = 0
        last = None
        for _, i, g, l in (r for r in rows if r[0] == key):
            want = missed
            gains, losses = gains + g, losses + l
            if l and losses - gains > missed:
                missed += 1
            assert (got[i]["gains"], got[i]["losses"], got[i]["missed"]) == (gains, losses, want)
            assert (back[i] and back[i]["i"]) == last
            last = i


def test_logistic_separates(spark):
    rng = np.random.default_rng(10)
    rows = [(i, f"p{i % 20}", "clean", int(i % 2), float(rng.normal() + 3 * (i % 2))) for i in range(200)]
    frame = spark.createDataFrame(rows, "item int, identity string, condition string, label int, f double")
    held, model = E.fit_logistic(frame, ["f"], 0.6, 1)
    quality_ = E.usable_detector(held, 0.9).first()
    assert quality_["auc"] > 0.9 and quality_["usable"] and model["weights"][0] > 0




@pytest.mark.parametrize("strategy", ["mean", "centroid", "topk_mean"])
def test_every_strategy_keeps_claims_and_distance(spark, strategy):
    rng = np.random.default_rng(4)
    refs = [(u, i, [float(x) for x in rng.standard_normal(6)], 6) for u in range(12) for i in range(5)]
    asked = [(p, [float(x) for x in rng.standard_normal(6)], 6, p % 12) for p in range(20)]
    got = M.identity_scores(spark.createDataFrame(asked, "probe_id int, vector array<double>, dim int, claim int"),
                            spark.createDataFrame(refs, "user_id int, ref_ix int, vector array<double>, dim int"), strategy).collect()
    table = {(r["probe_id"], r["user_id"]): r["euclidean"] for r in got}
    for p, v, _, claim in asked:
        assert (p, claim) in table
    for (p, u), distance in table.items():
        want = min(np.linalg.norm(np.array(v) - np.array(asked[p][1])) for user, _, v, _ in refs if user == u)
        assert distance == pytest.approx(want)
    assert len(got) <= 20 * 3


@pytest.mark.parametrize("width", [1, 5, 8])
def test_syndromes_find_what_all_patterns_find(spark, width):
    rng = random.Random(width)
    rows, want = [], {}
    for i in range(60):
        code = rng.getrandbits(32)
        word = code << 32 | zlib.crc32(code.to_bytes(4, "big"))
        ratios = [0.5 + (0.1 + rng.randrange(30) / 100) * (1 if word >> (63 - b) & 1 else -1) for b in range(64)]
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            ratios[b] = 1.0 - (0.5 + (ratios[b] - 0.5) / 10)
        rows += [(i, b, r) for b, r in enumerate(ratios)]
        weak = sorted(range(64), key=lambda b: (abs(ratios[b] - 0.5), b))[:width]
        read = sum(1 << (63 - b) for b, r in enumerate(ratios) if r > 0.5)
        for pattern in sorted(range(1 << width), key=lambda p: (p.bit_count(), p)):
            tried = read
            for k, b in enumerate(weak):
                tried ^= (pattern >> k & 1) << (63 - b)
            if zlib.crc32((tried >> 32).to_bytes(4, "big")) == tried & K.WORD:
                want[i] = (f"{tried >> 32:08x}", pattern.bit_count())
                break
    got = {r["image_id"]: (r["code"], r["flips"]) for r in K.chase_decode(spark.createDataFrame(rows, "image_id int, bit int, ratio double"), ["image_id"], width).collect()}
    assert got == want and len(want) > 10
    plan = K.chase_decode(spark.createDataFrame(rows, "image_id int, bit int, ratio double"), ["image_id"], 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # no row per pattern


def test_bit_accuracy_broadcasts_no_truth(spark):
    """Repeated and unreadable codes count as in a join bit by bit, and a truth of few bytes is not sent to every task."""
    tally = spark.createDataFrame([(i, b, [0.9, 0.1, None, 0.5][(i + b) % 4]) for i in range(4) for b in range(64)] + [(0, 3, 0.9), (1, None, 0.9), (1, 64, 0.9)],
                                  "image_id int, bit int, ratio double")
    truth = spark.createDataFrame([(0, "0000beef"), (0, "ffff0000"), (1, "12345678"), (2, None), (9, "00000001"), (None, "00000001")], "image_id int, code string")
    bits = truth.select("image_id", F.posexplode(codes.message_bits(F.col("code"))).alias("bit", "one")).collect()
    hits = {}
    for t in tally.collect():
        for u in bits:
            if t["image_id"] == u["image_id"] and t["bit"] == u["bit"]:
                hits.setdefault(t["image_id"], []).extend([] if None in (t["ratio"], u["one"]) else [float((t["ratio"] > 0.5) == (u["one"] == 1))])
    out = K.bit_accuracy(tally, truth)
    assert {r["image_id"]: r["bit_accuracy"] for r in out.collect()} == {k: sum(v) / len(v) if v else None for k, v in hits.items()}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_blocks_travel_together(spark, monkeypatch):
    """Fifty blocks of a side are seven batches, so a row is copied seven times; every pair still meets once, block by block."""
    copies, side = [], blocks._grid_side
    monkeypatch.setattr(blocks, "_grid_side", lambda *args: copies.append(side(*args)) or copies[-1])
    met = lambda x, y: pd.DataFrame({"pairs": [len(x) * len(y)], "most": [max(len(x), len(y))]})
    rows = spark.range(200).toDF("k")
    out = blocks.block_join(rows, rows, ["k"], ["k"], met, "pairs bigint, most bigint", rows=4).agg(F.sum("pairs"), F.max("most")).first()
    assert out[0] == 200 * 200 and out[1] < 20
    assert [c.count() for c in copies] == [200 * 7, 200 * 7]


def test_merged_finds_keep_copies_few(spark, monkeypatch):
    """Sixty blocks of a side are six batches where a task merges its finds: a photo is copied six times, and leaves the task once per batch."""
    rows, photos = _identities(spark, np.random.default_rng(8), people=6, photos=50)
    whole = {tuple(r) for r in M.leave_one_out(photos).collect()}, {tuple(r) for r in M.identity_score_counts(photos, 3).collect()}, {tuple(r) for r in M.alias_pairs(photos, 0.8).collect()}
    copies, side = [], blocks._grid_side
    monkeypatch.setattr(blocks, "_grid_side", lambda *args: copies.append(side(*args)) or copies[-1])
    monkeypatch.setattr(blocks.block_join, "__defaults__", ((), 5, None))
    monkeypatch.setattr(M, "BLOCK_ROWS", 5)  # every identity is too large for a block
    split = {tuple(r) for r in M.leave_one_out(photos).collect()}, {tuple(r) for r in M.identity_score_counts(photos, 3).collect()}, {tuple(r) for r in M.alias_pairs(photos, 0.8).collect()}
    for got, want in zip(split, whole):
        plain = lambda found: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found], key=str)
        assert plain(got) == plain(want)
    assert {c.count() for c in copies if c.count()} <= {300, 300 * 6}  # 300: beside a side without rows


def test_merged_roles():
    found = pd.DataFrame({"probe_id": [1, 2, 1, 2, 1, 3], "tops": [np.array(t) for t in ([0.5, 0.1], [], [0.7], [], [0.6], [0.2])],
                          "impostor": pd.Series([0.3, None, 0.4, 0.1, 0.4, None], dtype="object"), "impostor_id": pd.Series([9, None, 8, 2 ** 60 + 1, 7, None], dtype="object")})
    out = M._merge_own_and_rival(2)(found)
    assert [list(t) for t in out["tops"]] == [[0.7, 0.6], [], [0.2]] and list(out["probe_id"]) == [1, 2, 3]
    assert [(None if pd.isna(v) else v) for v in out["impostor_id"]] == [7, 2 ** 60 + 1, None]
