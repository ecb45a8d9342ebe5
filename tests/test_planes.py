"""Region statistics of whole planes against pixel-by-pixel sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import planes as P


def pictures(spark, arrays, key="image_id", names=("r", "g", "b"), faces=None):
    rows = [(i, *planes[0].shape, *[p.ravel().tolist() for p in planes], *([faces[i]] if faces else [])) for i, planes in enumerate(arrays)]
    box = ", faces array<struct<face_ix:int,x1:double,y1:double,x2:double,y2:double>>" if faces else ""
    return spark.createDataFrame(rows, f"{key} int, h int, w int, {', '.join(f'{n} array<double>' for n in names)}{box}")


def test_face_changes(spark):
    draw = np.random.default_rng(1)
    change = [draw.random((17, 23)) * 50, draw.random((9, 9)) * 5]
    faces = [[(0, 2.0, 3.0, 9.9, 11.0), (1, -4.7, -2.0, 8.0, 6.0), (2, 20.0, 12.0, 40.0, 30.0), (3, 5.0, 5.0, 6.5, 9.0), (4, None, 1.0, 4.0, 4.0), (5, 0.0, 0.0, 23.0, 17.0)], None]
    got = {(r.pair_id, r.face_ix): r.ratio for r in P.face_change_ratio(pictures(spark, [(c,) for c in change], "pair_id", ("change",), faces)).collect()}
    want = {}
    for ix, x1, y1, x2, y2 in faces[0]:
        want[0, ix] = None
        if x1 is None or ix in (3, 5):
            continue
        l, t, r, b = max(0, int(x1)), max(0, int(y1)), min(23, int(x2)), min(17, int(y2))
        gx, gy = (r - l) // 2, (b - t) // 2
        inner, ring = [], []
        for y in range(max(0, t - gy), min(17, b + gy)):
            for x in range(max(0, l - gx), min(23, r + gx)):
                (inner if l <= x < r and t <= y < b else ring).append(change[0][y, x])
        want[0, ix] = (np.mean(inner) + 0.5) / (np.mean(ring) + 0.5)
    assert got.keys() == want.keys()
    assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_layouts_of_many_faces(spark):
    draw = np.random.default_rng(2)
    planes = tuple(draw.integers(0, 256, (20, 30)).astype(float) for _ in range(3))
    boxes = [(0, 1, 2, 8, 9), (1, 0, 0, 30, 20), (2, 25, 15, 35, 25), (3, 40, 40, 50, 50), (4, 5, 5, 6, 6)]
    rows = [(0, 20, 30, *[p.ravel().tolist() for p in planes], boxes), (1, 20, 30, *[p.ravel().tolist() for p in planes], [])]
    table = spark.createDataFrame(rows, "image_id int, h int, w int, r array<double>, g array<double>, b array<double>, faces array<struct<face_ix:int,x1:int,y1:int,x2:int,y2:int>>")
    got = {r.face_ix: r.descriptor for r in P.appearance_planes(table).collect()}
    for ix, x1, y1, x2, y2 in boxes:
        want = np.zeros((2, 2, 3, 8))
        for y in range(y1, min(y2, 20)):
            for x in range(x1, min(x2, 30)):
                for c in range(3):
                    want[int(y - y1 >= (y2 - y1) // 2), int(x - x1 >= (x2 - x1) // 2), c, int(planes[c][y, x] * 8 // 256)] += 1
        assert got[ix] == pytest.approx((want / max(want.sum(), 1)).ravel())


def plain_share(part):
    h, w = part.shape
    lit = part * np.outer(np.hanning(h), np.hanning(w))
    waves = lambda n: np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n)
    power = np.abs(waves(h) @ lit @ waves(w)) ** 2
    away = np.array([[np.hypot(min(k, h - k), min(m, w - m)) for m in range(w)] for k in range(h)])
    return power[away > away.max() / 2].sum() / (power.sum() + 1e-6)


def test_blending_of_a_large_crop(spark):
    draw = np.random.default_rng(3)
    crop = tuple(draw.random((121, 130)) * 255 for _ in range(3))
    tiny = tuple(draw.random((31, 64)) for _ in range(3))
    line = tuple(draw.random((1, 64)) for _ in range(3))
    got = {r.image_id: r for r in P.blending_planes(pictures(spark, [crop, tiny, line])).collect()}
    assert all(got[i].reason == "crop too small" and got[i].noise_ratio is None for i in (1, 2)) and got[0].reason is None
    tone = 0.299 * crop[0] + 0.587 * crop[1] + 0.114 * crop[2]
    core, strip = tone[30:90, 32:97], tone[:18]
    assert got[0].spectral_ratio == pytest.approx(plain_share(core) / (plain_share(strip) + 1e-6), rel=1e-9)
    h, w = tone.shape
    away = np.array([[np.hypot((y - 60) / 60, (x - 64.5) / 64.5) for x in range(w)] for y in range(h)])
    inside, outside = away <= 0.55, away >= 0.75
    assert got[0].mean_difference == pytest.approx((tone[inside].mean() - tone[outside].mean()) / 255)
    assert got[0].std_ratio == pytest.approx((tone[inside].std() + 1e-6) / (tone[outside].std() + 1e-6))
    border = lambda part: (np.mean([abs(part[:, x] - part[:, x - 1]).mean() for x in range(1, part.shape[1]) if x % 8 == 0]) + np.mean([abs(part[y] - part[y - 1]).mean() for y in range(1, len(part)) if y % 8 == 0]))
    other = lambda part: (np.mean([abs(part[:, x] - part[:, x - 1]).mean() for x in range(1, part.shape[1]) if x % 8]) + np.mean([abs(part[y] - part[y - 1]).mean() for y in range(1, len(part)) if y % 8]))
    ratio = lambda part: border(part) / (other(part) + 1e-6)
    assert got[0].blockiness_ratio == pytest.approx(ratio(core) / (ratio(strip) + 1e-6))


def test_spectra(spark):
    power = np.random.default_rng(4).random((40, 50))
    got = P.spectrum_profiles(pictures(spark, [(power,)], names=("power",))).withColumn("flat", P.spectral_flatness(F.col("levels"))).first()
    rings = np.floor([[np.hypot(y - 20, x - 25) for x in range(50)] for y in range(40)])
    levels = [np.log1p(power[rings == k].mean()) for k in range(20)]
    assert got.levels == pytest.approx(levels)
    assert got.flat == pytest.approx(min(1.0, np.mean(levels[12:]) / np.mean(levels[4:12])))
    short = spark.range(1).select(P.spectral_flatness(F.array(*[F.lit(0.5)] * 10)).alias("a"), P.spectral_flatness(F.array(*[F.lit(0.5)] * 30)).alias("b")).first()
    assert (short.a, short.b) == (0.5, 0.5)


@pytest.mark.parametrize("name", ["appearance_histograms", "face_change_ratio", "blending_features", "radial_profile", "high_band_share", "spectral_flatness"])
def test_pictures_are_not_shuffled(spark, name):
    from sightline.catalog.planes import QUERIES

    assert "Exchange" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
