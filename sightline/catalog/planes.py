"""Queries on decoded planes: embeddings as 8x8 pictures, some tiled to larger ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import planes
from sightline.operators import planes as P

r6 = lambda name: F.round(name, 6).alias(name)


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    """8x8 pixels of every embedding, on the 8-bit scale but not cut to it."""
    cells = planes(spark, sf).select(F.col("vec_id").alias("image_id"), F.posexplode("plane").alias("i", "e"))
    return cells.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "i",
                        (128.0 + 300.0 * F.col("e")).alias("v"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every plane with a disturbed copy of itself."""
    moved = F.col("v") + 4.0 * ((F.col("i") * (F.col("image_id") + 3)) % 5) * (F.col("image_id") % 4)
    return _pixels(spark, sf).select(F.col("image_id").alias("pair_id"), "y", "x", F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("v").alias("a"),
                                     moved.alias("b"))


def psnr_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = P.psnr(_pairs(spark, sf))
    return out.select("pair_id", F.when(F.col("psnr") < F.lit(float("inf")), F.round("psnr", 6)).alias("psnr"))


def ssim_pairs(spark: SparkSession, sf: str) -> DataFrame:
    vec, side = F.col("vec_id"), F.lit(8)
    scaled = planes(spark, sf).select("vec_id", F.transform("plane", lambda e: 128.0 + 300.0 * e).alias("a"))
    moved = F.transform("a", lambda v, i: v + 4.0 * ((i * (vec + 3)) % 5) * (vec % 4))
    return P.ssim_planes(scaled.select(vec.alias("pair_id"), side.alias("h"), side.alias("w"), "a", moved.alias("b"))).select("pair_id", r6("ssim"))


def laplacian_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    return P.laplacian_variance(_pixels(spark, sf)).select("image_id", r6("sharpness"))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Every plane as an array on the 8-bit scale."""
    return planes(spark, sf).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("plane", lambda e: 128.0 + 300.0 * e).alias("v"))


def _boxes(face_ix: int = 0, **sides) -> Column:
    return F.array(F.struct(F.lit(face_ix).alias("face_ix"), *[value.alias(name) for name, value in sides.items()])).alias("faces")


def appearance_histograms(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec_id")
    unit = lambda of: F.transform("v", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(of(v)))))
    faces = _boxes(x1=(vec % 3).cast("int"), y1=(vec % 2).cast("int"), x2=(F.lit(7) + vec % 2).cast("int"), y2=F.lit(8))
    pictures = _scaled(spark, sf).select(vec.alias("image_id"), "h", "w", unit(lambda v: v).alias("r"), unit(lambda v: 255.0 - v).alias("g"), unit(lambda v: v / 2.0).alias("b"), faces)
    return P.appearance_planes(pictures).select("image_id", F.posexplode("descriptor").alias("slot", "share")).select("image_id", "slot", r6("share"))


def content_region(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures darkened, so that only their brightest cells are lit."""
    dark = _pixels(spark, sf).select("image_id", "y", "x", *[F.floor((F.col("v") - 150.0) / 2).cast("int").alias(c) for c in ("r", "g", "b")])
    return P.content_region(dark, 16)


def face_change_ratio(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec_id")
    faces = _boxes(x1=(vec % 5 - 1).cast("double"), y1=(vec % 4).cast("double"), x2=(vec % 5 + 3).cast("double"), y2=vec % 4 + 2.5)
    change = F.transform("v", lambda v, i: F.abs(v - (v + 4.0 * ((i * (vec + 3)) % 5) * (vec % 4))))
    pairs = _scaled(spark, sf).select(vec.alias("pair_id"), "h", "w", change.alias("change"), faces)
    return P.face_change_ratio(pairs).select("pair_id", "face_ix", r6("ratio"))


def _tiled(spark: SparkSession, sf: str, side: int) -> DataFrame:
    """Each plane tiled to a larger square ``e``; the pixel ``p`` lies in row ``p / side``."""
    tile = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda p: F.get("plane", (F.floor(p / side) % 8 * 8 + p % side % 8).cast("int")))
    return planes(spark, sf).select(F.col("vec_id").alias("image_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), tile.alias("e"))


def blending_features(spark: SparkSession, sf: str) -> DataFrame:
    row = lambda p: F.floor(p / 36)
    tone = lambda e, p: 128.0 + 200.0 * e + row(p) + 0.5 * (p % 36)
    plane = lambda of: F.transform("e", of)
    pictures = _tiled(spark, sf, 36).select("image_id", "h", "w", plane(tone).alias("r"), plane(lambda e, p: tone(e, p) * 0.9).alias("g"),
                                            plane(lambda e, p: tone(e, p) * 0.8 + row(p) % 3).alias("b"))
    out = P.blending_planes(pictures)
    return out.select("image_id", *[F.round(c, 1 if c == "spectral_ratio" else 5).alias(c) for c in out.columns if c not in ("image_id", "reason")])


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    power = F.transform("e", lambda e, p: e * e * 1000.0 / (1.0 + F.pow(F.floor(p / 48) - 24, 2) + F.pow(p % 48 - 24, 2)))
    return P.spectrum_profiles(_tiled(spark, sf, 48).select("image_id", "h", "w", power.alias("power")))


def radial_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).select("image_id", F.posexplode("levels").alias("radius", "level")).select("image_id", "radius", r6("level"))


def spectral_flatness(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).select("image_id", F.round(P.spectral_flatness(F.col("levels")), 6).alias("score"))


def high_band_share(spark: SparkSession, sf: str) -> DataFrame:
    return _profiles(spark, sf).select("image_id", r6("share"))


QUERIES = {f.__name__: f for f in (
    psnr_pairs, ssim_pairs, laplacian_sharpness, appearance_histograms, content_region, face_change_ratio, blending_features,
    radial_profile, spectral_flatness, high_band_share)}

_PX = """px AS (SELECT vec_id AS image_id, unnest(range(64)) AS i, 128.0 + 300.0 * unnest(embedding::DOUBLE[]) AS v0 FROM embeddings),
  p AS (SELECT image_id, i, i // 8 AS y, i % 8 AS x, v0::DOUBLE AS v FROM px),
  q AS (SELECT image_id, i, y, x, v AS a, v + 4.0 * ((i * (image_id + 3)) % 5) * (image_id % 4) AS b FROM p)"""
_TILE = """e AS (SELECT vec_id AS image_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS e FROM embeddings)"""
_REFLECT = "CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > {m} THEN 2 * {m} - ({v}) ELSE {v} END"
_SPEC = f"""{_TILE}, s AS (SELECT image_id, y, x, e * e * 1000.0 / (1.0 + (y - 24) ** 2 + (x - 24) ** 2) AS power
  FROM range(48) a(y), range(48) b(x), e WHERE e.i = (y % 8) * 8 + x % 8),
  r AS (SELECT image_id, floor(sqrt((y - 24) ** 2 + (x - 24) ** 2))::INT AS radius, ln(1 + avg(power)) AS level FROM s GROUP BY ALL),
  prof AS (SELECT * FROM r WHERE radius < 24)"""

ORACLES = {
    "psnr_pairs": f"""WITH {_PX}, m AS (SELECT image_id, avg((a - b) ** 2) AS mse FROM q GROUP BY 1) SELECT image_id AS pair_id,
      CASE WHEN mse > 0 THEN round(10 * log10(255.0 ** 2 / mse), 6) END AS psnr FROM m""",
    "ssim_pairs": f"""WITH {_PX}, o AS (SELECT dy, dx FROM range(-3, 4) t(dy), range(-3, 4) r(dx)),
      w AS (SELECT c.image_id, c.y, c.x, avg(n.a) AS ma, avg(n.b) AS mb, avg(n.a * n.a) AS aa, avg(n.b * n.b) AS bb, avg(n.a * n.b) AS ab
      FROM q c, o, q n WHERE n.image_id = c.image_id AND n.y = {_REFLECT.format(v='c.y + dy', m=7)}
      AND n.x = {_REFLECT.format(v='c.x + dx', m=7)} GROUP BY ALL)
      SELECT image_id AS pair_id, round(avg(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025)
      * (aa - ma * ma + bb - mb * mb + 58.5225))), 6) AS ssim FROM w GROUP BY 1""",
    "laplacian_sharpness": f"""WITH {_PX}, l AS (SELECT c.image_id, c.y, c.x, sum(n.v) - 4 * any_value(c.v) AS l FROM p c JOIN p n
      ON n.image_id = c.image_id AND abs(n.y - c.y) + abs(n.x - c.x) = 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY ALL)
      SELECT image_id, round(var_pop(l), 6) AS sharpness FROM l GROUP BY 1""",
    "appearance_histograms": f"""WITH {_PX}, c AS (SELECT image_id, y, x, [least(255, greatest(0, floor(v)))::INT,
      least(255, greatest(0, floor(255.0 - v)))::INT, least(255, greatest(0, floor(v / 2.0)))::INT] AS rgb FROM p),
      f AS (SELECT vec_id AS image_id, vec_id % 3 AS x1, vec_id % 2 AS y1, 7 + vec_id % 2 AS x2 FROM embeddings),
      s AS (SELECT c.image_id, (((y - y1 >= (8 - y1) // 2)::INT * 2 + (x - x1 >= (x2 - x1) // 2)::INT) * 3 + ch) * 8 + rgb[ch + 1] // 32 AS slot
      FROM c JOIN f USING (image_id), range(3) t(ch) WHERE x >= x1 AND x < x2 AND y >= y1),
      n AS (SELECT image_id, slot, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT image_id, sum(n) AS total FROM n GROUP BY 1)
      SELECT f.image_id, k.slot, round(coalesce(n.n / total, 0), 6) AS share FROM f CROSS JOIN range(96) k(slot) JOIN t ON t.image_id = f.image_id
      LEFT JOIN n ON n.image_id = f.image_id AND n.slot = k.slot""",
    "content_region": f"""WITH {_PX}, l AS (SELECT image_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM p
      WHERE floor((v - 150.0) / 2) > 16 GROUP BY 1) SELECT vec_id AS image_id, coalesce(x1, 0) AS x1, coalesce(y1, 0) AS y1,
      coalesce(x2, 8) AS x2, coalesce(y2, 8) AS y2 FROM embeddings LEFT JOIN l ON l.image_id = vec_id""",
    "face_change_ratio": f"""WITH {_PX}, f AS (SELECT vec_id AS image_id, greatest(0, vec_id % 5 - 1) AS l, vec_id % 5 + 3 AS r, vec_id % 4 AS t,
      vec_id % 4 + 2 AS d FROM embeddings), g AS (SELECT *, (r - l) // 2 AS gx, (d - t) // 2 AS gy FROM f),
      k AS (SELECT q.image_id, abs(a - b) AS c, x >= l AND x < r AND y >= t AND y < d AS inner_ FROM q JOIN g USING (image_id)
      WHERE x >= greatest(0, l - gx) AND x < least(8, r + gx) AND y >= greatest(0, t - gy) AND y < least(8, d + gy))
      SELECT image_id AS pair_id, 0 AS face_ix, round((avg(CASE WHEN inner_ THEN c END) + 0.5) / (avg(CASE WHEN NOT inner_ THEN c END) + 0.5), 6)
      AS ratio FROM k GROUP BY 1""",
    "blending_features": f"""WITH {_TILE}, b AS (SELECT image_id, y, x, 128.0 + 200.0 * e + y + 0.5 * x AS r, y % 3 AS m FROM range(36) a(y), range(36) c(x), e
      WHERE e.i = (y % 8) * 8 + x % 8), g AS (SELECT image_id, y, x, r::DOUBLE * 0.299::DOUBLE + r * 0.9::DOUBLE * 0.587::DOUBLE
      + (r * 0.8::DOUBLE + m) * 0.114::DOUBLE AS v, greatest(r, r * 0.8 + m) AS hi, least(r * 0.9, r * 0.8 + m, r) AS lo FROM b),
      s AS (SELECT *, (hi - lo) / (hi + 1e-6) AS sat, sqrt(((y - 17.5) / 17.5) ** 2 + ((x - 17.5) / 17.5) ** 2) AS away FROM g),
      o AS (SELECT dy, dx FROM range(-1, 2) t(dy), range(-1, 2) u(dx)),
      n AS (SELECT c.image_id, c.y, c.x, any_value(c.v) AS v, any_value(c.sat) AS sat, any_value(c.away) AS away,
        abs(any_value(c.v) - avg(k.v)) AS noise, abs(sum(CASE WHEN abs(dy) + abs(dx) = 1 THEN k.v ELSE 0 END) - 4 * any_value(c.v)) AS sharp
        FROM (SELECT s.*, dy, dx, {_REFLECT.format(v='y + dy', m=35)} AS ny, {_REFLECT.format(v='x + dx', m=35)} AS nx FROM s, o) c
        JOIN s k ON k.image_id = c.image_id AND k.y = c.ny AND k.x = c.nx GROUP BY c.image_id, c.y, c.x),
      mm AS (SELECT image_id, avg(sharp) AS sm FROM n GROUP BY 1),
      st AS (SELECT n.image_id, avg(noise) FILTER (WHERE away <= 0.55) AS ni, avg(noise) FILTER (WHERE away >= 0.75) + 1e-6 AS no,
        avg(sharp) FILTER (WHERE away <= 0.55) AS si, avg(sharp) FILTER (WHERE away >= 0.75) + 1e-6 AS so, avg(v) FILTER (WHERE away <= 0.55) AS vi,
        avg(v) FILTER (WHERE away >= 0.75) AS vo, stddev_pop(v) FILTER (WHERE away <= 0.55) AS di, stddev_pop(v) FILTER (WHERE away >= 0.75) AS dd,
        avg(sharp) FILTER (WHERE away > 0.5 AND away < 0.75) AS ss, avg(sat) FILTER (WHERE away <= 0.55) AS ti,
        avg(sat) FILTER (WHERE away >= 0.75) AS too, avg((sharp > 3 * sm)::INT) AS edges FROM n JOIN mm USING (image_id) GROUP BY 1),
      inn AS (SELECT image_id, y - 9 AS y, x - 9 AS x, v FROM s WHERE y BETWEEN 9 AND 26 AND x BETWEEN 9 AND 26),
      steps AS (SELECT a.image_id, 'x' AS ax, a.x % 8 = 0 AS bd, abs(a.v - b.v) AS d FROM inn a JOIN inn b ON a.image_id = b.image_id AND a.y = b.y
        AND a.x = b.x + 1 UNION ALL SELECT a.image_id, 'y', a.y % 8 = 0, abs(a.v - b.v) FROM inn a JOIN inn b ON a.image_id = b.image_id AND a.x = b.x
        AND a.y = b.y + 1),
      bl AS (SELECT image_id, (avg(d) FILTER (WHERE bd AND ax = 'x') + avg(d) FILTER (WHERE bd AND ax = 'y'))
        / (avg(d) FILTER (WHERE NOT bd AND ax = 'x') + avg(d) FILTER (WHERE NOT bd AND ax = 'y') + 1e-6) AS bi FROM steps GROUP BY 1)
      , hann AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 17) AS f FROM range(18) t(i)),
      wv AS (SELECT image_id, y, x, v * hy.f * hx.f AS v FROM inn JOIN hann hy ON hy.i = y JOIN hann hx ON hx.i = x),
      fx AS (SELECT image_id, y, k, sum(v * cos(2 * pi() * x * k / 18)) AS re, -sum(v * sin(2 * pi() * x * k / 18)) AS im FROM wv, range(18) t(k) GROUP BY ALL),
      fy AS (SELECT image_id, k, l, sum(re * cos(2 * pi() * y * l / 18) + im * sin(2 * pi() * y * l / 18)) AS re,
        sum(im * cos(2 * pi() * y * l / 18) - re * sin(2 * pi() * y * l / 18)) AS im FROM fx, range(18) t(l) GROUP BY ALL),
      sp AS (SELECT image_id, sum(CASE WHEN least(k, 18 - k) ** 2 + least(l, 18 - l) ** 2 > 40.5 THEN re * re + im * im ELSE 0 END) / (sum(re * re + im * im) + 1e-6) AS high
        FROM fy GROUP BY 1)
      SELECT image_id, round(ni / no, 5) AS noise_ratio, round(si / so, 5) AS sharpness_ratio, round(bi / 1e-6, 5) AS blockiness_ratio,
      round(high / 1e-6, 1) AS spectral_ratio, round((vi - vo) / 255, 5) AS mean_difference, round((di + 1e-6) / (dd + 1e-6), 5) AS std_ratio,
      round(ss / so, 5) AS seam_edge_ratio, round(ti - too, 5) AS saturation_difference, round(ni / 255, 5) AS interior_noise,
      round(si / 255, 5) AS interior_sharpness, round(edges, 5) AS edge_density FROM st JOIN bl USING (image_id) JOIN sp USING (image_id)""",
    "radial_profile": f"WITH {_SPEC} SELECT image_id, radius, round(level, 6) AS level FROM prof",
    "spectral_flatness": f"""WITH {_SPEC} SELECT image_id, round(least(1.0, greatest(0.0, avg(level) FILTER (WHERE radius >= 14)
      / (abs(avg(level) FILTER (WHERE radius BETWEEN 4 AND 13)) + 1e-9))), 6) AS score FROM prof GROUP BY 1""",
    "high_band_share": f"""WITH {_SPEC}, m AS (SELECT image_id, max(sqrt((y - 24) ** 2 + (x - 24) ** 2)) AS lim FROM s GROUP BY 1)
      SELECT image_id, round(sum(CASE WHEN sqrt((y - 24) ** 2 + (x - 24) ** 2) > lim * 0.5 THEN power ELSE 0 END) / (sum(power) + 1e-6), 6) AS share
      FROM s JOIN m USING (image_id) GROUP BY 1""",
}
