"""Queries on single records: boxes, quality, vectors, credentials, and the round trips of the registry's files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import assets, planes
from sightline.functions import boxes as B
from sightline.functions import quality as Q
from sightline.functions import vectors as X
from sightline.plans import verdicts as V
from sightline.session import shared_folder, table
from sightline.settings import FaceThresholds
from sightline.sources import manifests, registry
from sightline.sources import media
from sightline.sources.media import pixel_digest

r6 = lambda column, name: F.round(column, 6).alias(name)


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def folder_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file of a folder tree, every ninth without a media suffix: listed, and digested by its bytes."""
    root = _path(spark, "folder")
    n = F.col("doc_id")
    suffix = F.get(F.array(*[F.lit(s) for s in (".jpg", ".PNG", ".mp4", ".webp", ".txt", ".mkv", ".bmp", "", ".mov")]), (n % 9).cast("int"))
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), n, suffix).alias("name"), (n % 4).alias("shelf"), F.coalesce("text", F.lit("")).alias("value"))

    def write(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root) if ":" in root else (LocalFileSystem(), root)
        for part in rows:
            for name, shelf, value in zip(part["name"], part["shelf"], part["value"]):
                store.create_dir(f"{base}/shelf-{shelf}", recursive=True)
                with store.open_output_stream(f"{base}/shelf-{shelf}/{name}") as file:
                    file.write(value.encode())
            yield part[["name"]]

    docs.mapInPandas(write, "name string").count()
    listed = media.media_manifest(spark, root).select("uri", "kind", "source", "size_bytes")
    digested = media.media_content(spark, root).select("uri", "sha256", F.col("size_bytes").alias("digested_bytes"))
    tail = F.regexp_extract("uri", "(shelf-[0-9]/[^/]+)$", 1)
    return listed.join(digested, "uri").select(tail.alias("place"), "kind", "source", "size_bytes", "digested_bytes", "sha256")


def box_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as two detections of one frame."""
    n = F.col("event_id")
    d = lambda c: c.cast("double")
    a = B.make_box(n % 90 - 5, n % 70 - 3, n % 90 + 5 + n % 31, n % 70 + 7 + n % 23)
    b = B.make_box(n % 83 + 0.5, n % 61 + 0.25, n % 83 + 12.5, n % 61 + 9.75)
    held = table(spark, sf, "events").select("event_id", a.alias("a"), b.alias("b"), d(n % 11 / 10).alias("confidence"))
    a, b, w, h = F.col("a"), F.col("b"), F.lit(100.0), F.lit(80.0)
    grown, crop, moved = B.margin_crop(a, 0.25, w, h), B.face_crop_box(b, w, h), B.rescale(B.shift(b, F.lit(3.0), F.lit(-2.0)), F.lit(0.5))
    corner = lambda box, name: [box[c].alias(f"{name}_{c}") for c in ("x1", "y1", "x2", "y2")]
    return held.select("event_id", B.box_area(a).alias("area"), r6(B.box_iou(a, b), "iou"), *corner(grown, "grown"), *corner(crop, "crop"),
                       *corner(moved, "moved"), B.is_plausible(a, F.col("confidence"), w, F.lit(40.0)).alias("plausible"),
                       r6(B.centre_distance(a, w, h, b, F.lit(50.0), F.lit(40.0)), "distance"))


def face_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Size and sharpness of every event's face, and the thresholds that a poor one raises."""
    n, limits = F.col("event_id"), FaceThresholds(quality_penalty=0.1)
    pixels, sharp = F.when(n % 17 > 0, n % 160).cast("double"), (n % 240).cast("double")
    quality = Q.face_quality(pixels, sharp)
    held = table(spark, sf, "events").select("event_id", pixels.alias("pixels"), quality.alias("quality"))
    candidate, high = Q.effective_thresholds(F.col("quality"), limits)
    points = Q.operating_points((F.col("event_id") % 101) / 100.0)
    return held.select("event_id", r6("quality", "quality"), Q.is_small_face(F.col("pixels")).alias("small"), r6(candidate, "candidate"), r6(high, "high"),
                       Q.raise_note(F.col("quality"), limits).isNotNull().alias("noted"), points["suspicious"].alias("suspicious_from"), points["high"].alias("high_from"))


def head_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Landmarks of every event's face: eyes, nose, mouth corners; every seventh has too few."""
    n = F.col("event_id")
    point = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    marks = F.array(point(n % 13), point(20 + n % 7), point(5 + n % 19), point(F.lit(6)), point(F.lit(15)))
    held = table(spark, sf, "events").select("event_id", F.when(n % 7 == 0, F.slice(marks, 1, 3)).otherwise(marks).alias("marks"))
    moved = B.rescale_landmarks(B.shift_landmarks(F.col("marks"), F.lit(4.0), F.lit(1.0)), F.lit(2.0))
    return held.select("event_id", r6(B.frontality(F.col("marks")), "frontality"), moved[2]["x"].alias("nose_x"))


def vector_blends(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with its mirror image: averaged, fused, as histograms, and under a logistic model of four components."""
    v = F.col("plane")
    back = F.reverse(v)
    total = lambda x: X.total(F.transform(x, lambda y: F.abs(y)))
    part = lambda x: F.transform(x, lambda y: F.abs(y) / total(x))
    average, fused = X.flip_average(v, back), X.fuse_embeddings(v, back)
    return planes(spark, sf).select(
        "vec_id", r6(X.cosine_similarity(average, v), "average_cosine"), F.size(fused).alias("fused_dim"), r6(X.cosine_similarity(fused, X.fuse_embeddings(v, v)), "fused_cosine"),
        r6(X.histogram_intersection(part(v), part(back)), "overlap"), r6(X.euclidean_distance(v, back), "distance"),
        r6(X.logistic_score(v, [0.1, 0.0, -0.1, 0.2], [0.5, 1.0, 2.0, 0.25], [1.0, -2.0, 0.5, 0.75], 0.3), "score"))


def vector_digests(spark: SparkSession, sf: str) -> DataFrame:
    """What may leave the store in place of a vector, by value."""
    return planes(spark, sf).select("vec_id", X.embedding_digest(F.col("plane")).alias("digest"))


def pixel_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's bytes as pixels of a picture one row high."""
    n = F.octet_length("text")
    return table(spark, sf, "documents").select("doc_id", pixel_digest(F.encode("text", "UTF-8"), F.lit(1), n).alias("digest"))


def content_credentials(spark: SparkSession, sf: str) -> DataFrame:
    """Credentials of every customer's file, in all states."""
    k = F.col("c_custkey")
    held = F.struct((k % 7 > 0).alias("supported"), F.when(k % 5 == 0, F.lit(None).cast("boolean")).otherwise(k % 5 > 1).alias("present"), (k % 3 == 0).alias("trusted"),
                    (k % 2 == 0).alias("verified"), F.when(k % 4 > 0, F.col("c_name")).alias("issuer"), F.when(k % 11 > 0, F.lit("tool")).alias("claim_generator"),
                    F.when(k % 10 == 0, F.lit("broken")).alias("reason"), F.array(F.lit("c1"), F.lit("c2")).alias("codes"))
    return table(spark, sf, "customer").select("c_custkey", V.describe_credentials(held).alias("credentials"))


def copy_scales(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    face = F.when(k % 3 == 0, F.lit(0.75))
    return table(spark, sf, "customer").select("c_custkey", V.copy_scale(face, 100 + k % 50, 80 + k % 40, F.lit(200), F.lit(150)).alias("scale"))


def asset_files(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document per supplier's asset, a third of them replaced, written and read back."""
    path, k, none = _path(spark, "assets"), F.col("s_suppkey"), F.lit(None).cast("string")
    rows = table(spark, sf, "supplier").select(
        k.cast("string").alias("asset_id"), F.concat(F.lit("user-"), k % 7).alias("user_id"), F.col("s_name").alias("sha256"), none.alias("phash"), none.alias("dhash"),
        (100 + k % 9).cast("int").alias("width"), F.lit(80).alias("height"), none.alias("watermark_code"), none.alias("distribution_id"), none.alias("protected_path"),
        none.alias("created_at"), (k % 2 == 0).alias("shielded"))
    newer = rows.where(k % 3 == 0).withColumn("width", F.lit(999))
    registry.assets_sink(registry.upsert(rows, newer, "asset_id"), path)
    return registry.assets_table(spark, path).select("asset_id", "user_id", "width", "shielded")


def identity_files(spark: SparkSession, sf: str) -> DataFrame:
    """Identities and vectors saved apart and loaded together, one of them deleted again."""
    path, user = _path(spark, "identities"), F.concat(F.lit("user "), F.col("label"))
    vectors = planes(spark, sf).select(user.alias("user_id"), F.col("vec_id").alias("ref_ix"), F.col("plane").alias("vector"))
    registry.save_identities(vectors.groupBy("user_id").agg(F.count("*").alias("image_count")), vectors, path)
    identities, stored = registry.delete_identity(*registry.load_identities(spark, path), "user 3")
    return identities.join(stored.groupBy("user_id").agg(F.count("*").alias("vectors")), "user_id").select("user_id", "file_name", "image_count", "vectors")


def evidence_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all assets written to the evidence store; ids and reports as read back."""
    path = _path(spark, "evidence")
    records = assets(spark, sf).select("asset_id", "user_id", F.lit("2024-01-01").alias("created_at"))
    registry.evidence_sink(records, path, ["asset_id", "user_id"])
    ids = registry.evidence_read(spark, path).select("analysis_id")
    return spark.read.parquet(path).join(ids, "analysis_id").select("asset_id", "analysis_id", "report")


def identity_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A list of files and identities written as text and read back, beside the identity that the name gives."""
    path = _path(spark, "list")
    name = F.concat(F.lit("photos/"), F.col("lang"), F.lit("_"), F.col("doc_id"), F.lit(".jpg"))
    table(spark, sf, "documents").select(F.concat(name, F.lit("\t"), F.col("source")).alias("value")).write.text(path)
    return manifests.identity_list(spark, path).select("file", "identity", manifests.identity_from_name(F.col("file")).alias("by_name"))


def result_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows with the environment they came from, written as CSV and read back."""
    path = _path(spark, "results")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = rows.join(table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers")), "n_nationkey")
    manifests.results_sink(rows, {"host": "any", "seed": "7"}, path)
    return spark.read.option("header", True).schema("n_nationkey BIGINT, n_name STRING, customers BIGINT, env_host STRING, env_seed STRING").csv(path)


QUERIES = {f.__name__: f for f in (
    folder_listing, box_geometry, face_quality, head_poses, vector_blends, vector_digests, pixel_digests, content_credentials, copy_scales, asset_files, identity_files,
    evidence_files, identity_lists, result_files)}

ORACLES = {
    "folder_listing": """WITH s AS (SELECT doc_id, doc_id % 9 AS k, octet_length(encode(coalesce(text, ''))) AS n, sha256(coalesce(text, '')) AS h FROM documents)
      SELECT 'shelf-' || (doc_id % 4) || '/doc-' || doc_id || ['.jpg', '.PNG', '.mp4', '.webp', '.txt', '.mkv', '.bmp', '', '.mov'][k + 1] AS place,
      CASE WHEN k IN (2, 5, 8) THEN 'video' ELSE 'image' END AS kind, 'local' AS source, n::BIGINT AS size_bytes, n::BIGINT AS digested_bytes, h AS sha256
      FROM s WHERE k NOT IN (4, 7)""",
    "box_geometry": """WITH e AS (SELECT event_id, (event_id % 90 - 5)::DOUBLE AS ax1, (event_id % 70 - 3)::DOUBLE AS ay1, (event_id % 90 + 5 + event_id % 31)::DOUBLE AS ax2,
        (event_id % 70 + 7 + event_id % 23)::DOUBLE AS ay2, event_id % 83 + 0.5::DOUBLE AS bx1, event_id % 61 + 0.25::DOUBLE AS by1, event_id % 83 + 12.5::DOUBLE AS bx2,
        event_id % 61 + 9.75::DOUBLE AS by2, event_id % 11 / 10 AS conf FROM events),
      g AS (SELECT *, ax2 - ax1 AS w, ay2 - ay1 AS h, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS shared FROM e)
      SELECT event_id, w * h AS area, round(shared / (w * h + 12 * 9.5 - shared), 6) AS iou,
        greatest(0, round_even(ax1 - w / 4, 0)) AS grown_x1, greatest(0, round_even(ay1 - h / 4, 0)) AS grown_y1, least(100, round_even(ax2 + w / 4, 0)) AS grown_x2,
        least(80, round_even(ay2 + h / 4, 0)) AS grown_y2, floor(least(99, bx1)) AS crop_x1, floor(least(79, by1)) AS crop_y1,
        floor(greatest(floor(least(99, bx1)) + 1, least(100, bx2))) AS crop_x2, floor(greatest(floor(least(79, by1)) + 1, least(80, by2))) AS crop_y2,
        (bx1 + 3) * 0.5 AS moved_x1, (by1 - 2) * 0.5 AS moved_y1, (bx2 + 3) * 0.5 AS moved_x2, (by2 - 2) * 0.5 AS moved_y2,
        NOT (conf < 0.7 AND least(w, h) > 20) AS plausible,
        round(sqrt(((ax1 + ax2) / 2 / 100 - (bx1 + bx2) / 2 / 50) ** 2 + ((ay1 + ay2) / 2 / 80 - (by1 + by2) / 2 / 40) ** 2), 6) AS distance FROM g""",
    "face_quality": """WITH e AS (SELECT event_id, CASE WHEN event_id % 17 > 0 THEN event_id % 160 END AS p, event_id % 240 AS s, event_id % 101 / 100 AS t FROM events),
      q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, p / 112, s / 120) END AS q FROM e)
      SELECT event_id, round(q, 6) AS quality, coalesce(p < 80, false) AS small, round(0.3591::DOUBLE + 0.1::DOUBLE * (1 - coalesce(q, 1)), 6) AS candidate,
        round(0.47::DOUBLE + 0.1::DOUBLE * (1 - coalesce(q, 1)), 6) AS high, coalesce(q < 1, false) AS noted,
        CASE WHEN t > 0 AND t < 1 THEN round(t, 6) END AS suspicious_from, CASE WHEN t > 0 AND t < 1 THEN round(t + (1 - t) / 2, 6) END AS high_from FROM q""",
    "head_poses": """WITH e AS (SELECT event_id, event_id % 13 AS l, 20 + event_id % 7 AS r, 5 + event_id % 19 AS n FROM events)
      SELECT event_id, CASE WHEN event_id % 7 = 0 OR abs(n - l) + abs(r - n) = 0 THEN 0.5 ELSE round(1 - abs(abs(n - l) - abs(r - n)) / (abs(n - l) + abs(r - n)), 6) END AS frontality,
        (n + 4.0::DOUBLE) * 2 AS nose_x FROM e""",
    "vector_blends": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings),
      s AS (SELECT *, list_transform(list_zip(a, b), lambda z: (z[1] + z[2]) / 2) AS m, list_sum(list_transform(a, lambda x: abs(x))) AS t,
        sqrt(list_dot_product(a, a)) AS n FROM v)
      SELECT vec_id, round(list_dot_product(m, a) / (sqrt(list_dot_product(m, m)) * n), 6) AS average_cosine, 128::INT AS fused_dim,
        round((1 + list_dot_product(a, b) / (n * n)) / 2, 6) AS fused_cosine,
        round(list_sum(list_transform(list_zip(a, b), lambda z: least(abs(z[1]), abs(z[2])) / t)), 6) AS overlap,
        round(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) ** 2))), 6) AS distance,
        round(1 / (1 + exp(-((a[1] - 0.1) / 0.5 - 2 * a[2] + (a[3] + 0.1) / 2 * 0.5 + (a[4] - 0.2) / 0.25 * 0.75 + 0.3))), 6) AS score FROM s""",
    "vector_digests": """SELECT vec_id, substr(sha256(array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.6f', x)), ',')), 1, 12) AS digest FROM embeddings""",
    "pixel_digests": """SELECT doc_id, sha256('(1, ' || octet_length(encode(text)) || ', 3)' || text) AS digest FROM documents""",
    "content_credentials": """WITH c AS (SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_name END, 'unknown') AS signer,
        CASE WHEN c_custkey % 11 > 0 THEN 'tool' ELSE 'unknown' END AS tool FROM customer)
      SELECT k AS c_custkey, CASE WHEN k % 7 = 0 THEN 'credentials=unchecked' WHEN k % 5 = 1 THEN 'credentials=absent'
        WHEN k % 5 = 0 THEN 'credentials=unreadable reason=' || CASE WHEN k % 10 = 0 THEN 'broken' ELSE 'unknown' END
        WHEN k % 3 = 0 THEN 'credentials=trusted signer=' || signer || ' tool=' || tool WHEN k % 2 = 0 THEN 'credentials=verified signer=' || signer || ' tool=' || tool
        ELSE 'credentials=invalid codes=c1,c2' END AS credentials FROM c""",
    "copy_scales": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.75::DOUBLE ELSE round(least((100 + c_custkey % 50) / 200, (80 + c_custkey % 40) / 150), 4) END AS scale FROM customer""",
    "asset_files": """SELECT s_suppkey::VARCHAR AS asset_id, 'user-' || s_suppkey % 7 AS user_id, (CASE WHEN s_suppkey % 3 = 0 THEN 999 ELSE 100 + s_suppkey % 9 END)::INT AS width,
      s_suppkey % 2 = 0 AS shielded FROM supplier""",
    "identity_files": """SELECT 'user ' || label AS user_id, 'user_' || label AS file_name, count(*) AS image_count, count(*) AS vectors FROM embeddings WHERE label <> 3 GROUP BY label""",
    "evidence_files": """SELECT vec_id AS asset_id, substr(sha256(vec_id || '|user-' || label), 1, 16) AS analysis_id,
      '{"asset_id":' || vec_id || ',"user_id":"user-' || label || '","created_at":"2024-01-01"}' AS report FROM embeddings""",
    "identity_lists": """SELECT 'photos/' || lang || '_' || doc_id || '.jpg' AS file, source AS identity, lang AS by_name FROM documents""",
    "result_files": """SELECT n_nationkey::BIGINT AS n_nationkey, n_name, count(*) AS customers, 'any' AS env_host, '7' AS env_seed FROM nation JOIN customer ON c_nationkey = n_nationkey
      GROUP BY n_nationkey, n_name""",
}
