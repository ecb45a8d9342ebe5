"""How the driver's tables stand in for media-evidence tables (whole tables, no subsets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import table


def photos(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding is a photo, its label the identity shown."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("name"), F.col("label").alias("identity"), F.col("embedding").alias("vector"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return photos(spark, sf).select(F.col("name").alias("probe_id"), "vector", F.size("vector").alias("dim"),
                                    F.col("identity").alias("own"))


def references(spark: SparkSession, sf: str) -> DataFrame:
    return photos(spark, sf).select(F.col("identity").alias("user_id"), F.col("name").alias("ref_ix"),
                                    F.col("name").alias("ref_name"), "vector", F.size("vector").alias("dim"))


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Detector scores: document length as score, ``toxic`` as truth, language as group."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"), "quality")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("grp"), F.col("n_chars").cast("double").alias("score"), "label",
        F.col("doc_id").alias("ord"), "source", "quality")


# Shared oracle fragments.
UNIT = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS raw,
  list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[],
  embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings)"""

LABELLED = """s AS (SELECT d.lang AS grp, d.n_chars::DOUBLE AS score, l.toxic AS label, d.doc_id AS ord,
  d.source, l.quality FROM documents d JOIN labels l USING (doc_id))"""


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a flat 8x8 plane."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("plane"))


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding plane is a registered asset of the user its label names."""
    from sightline.functions.hashes import perceptual_hash
    n = F.col("vec_id") % 5
    return planes(spark, sf).select(
        F.col("vec_id").alias("asset_id"), F.concat(F.lit("user-"), F.col("label")).alias("user_id"),
        F.sha2(F.concat(F.lit("asset-"), F.col("vec_id")), 256).alias("sha256"), perceptual_hash(F.col("plane")).alias("phash"),
        F.lower(F.lpad(F.hex(F.col("vec_id") * 7919 + 65536), 8, "0")).alias("watermark_code"),
        F.concat(F.lit("channel-"), F.col("vec_id") % 3).alias("distribution_id"),
        (F.lit(200) + n * 40).cast("int").alias("width"), (F.lit(150) + n * 30).cast("int").alias("height"),
        (F.col("vec_id") % 11 == 0).alias("shielded"), F.col("label"), F.col("plane"))


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """A disturbed copy of every plane; a quarter keep their bytes, a quarter keep only their mark."""
    from sightline.functions.hashes import perceptual_hash
    vec = F.col("vec_id")
    disturbed = F.transform("plane", lambda x, i: x + 0.015 * ((i * (vec + 3)) % 5))
    return planes(spark, sf).select(
        vec.alias("content_id"),
        F.sha2(F.concat(F.when(vec % 4 == 0, F.lit("asset-")).otherwise(F.lit("copy-")), vec), 256).alias("sha256"),
        F.when(vec % 4 == 1, F.lower(F.lpad(F.hex(vec * 7919 + 65536), 8, "0"))).alias("code"),
        perceptual_hash(disturbed).alias("phash"), (F.lit(160) + (vec % 2) * 8).cast("int").alias("width"),
        (F.lit(120) + (vec % 2) * 6).cast("int").alias("height"), disturbed.alias("plane"), F.col("label"))


# Oracle: h(kind, vec_id, label, bits, phash) with kind 'asset' or 'copy'.
HASHES = """basis AS (SELECT f, x, sqrt((CASE WHEN f = 0 THEN 1.0 ELSE 2.0 END) / 8.0)
    * cos(pi() * (2 * x + 1) * f / 16.0) AS b FROM range(8) t(f), range(8) r(x)),
  cells AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS val FROM embeddings),
  both_kinds AS (SELECT 'asset' AS kind, vec_id, label, i, val FROM cells UNION ALL
    SELECT 'copy', vec_id, label, i, val + 0.015 * ((i * (vec_id + 3)) % 5) FROM cells),
  across AS (SELECT kind, vec_id, label, i // 8 AS y, f AS v, sum(val * b) AS s FROM both_kinds JOIN basis ON i % 8 = x
    GROUP BY ALL),
  coef AS (SELECT kind, vec_id, label, f * 8 + v AS i, sum(s * b) AS c FROM across JOIN basis ON y = x GROUP BY kind, vec_id,
    label, f, v),
  med AS (SELECT kind, vec_id, quantile_cont(c, 0.5) AS m FROM coef WHERE i >= 8 AND i % 8 > 0 GROUP BY ALL),
  nib AS (SELECT kind, vec_id, label, i // 4 AS j, sum((c > m)::INT * (8 >> (i % 4)::INT))::INT AS n
    FROM coef JOIN med USING (kind, vec_id) GROUP BY ALL),
  h AS (SELECT kind, vec_id, label, string_agg(format('{:x}', n), '' ORDER BY j) AS phash,
    sum(n::HUGEINT << (60 - 4 * j)::INT)::HUGEINT AS bits FROM nib GROUP BY ALL)"""
