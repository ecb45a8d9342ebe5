"""Queries on streams, run over the given tables to the end, and the two plug-in hooks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog import verdicts as VQ
from sightline.catalog.inputs import HASHES, assets, copies
from sightline.catalog.video import _FRAMES, PAIRED, paired_tracks, two_face_detections
from sightline.functions import plugins
from sightline.plans import verdicts as V
from sightline.session import shared_folder, table
from sightline.settings import SamplingRules, TrackingRules
from sightline.streaming import streams as S


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint directory."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _drain(spark: SparkSession, name: str, rows: DataFrame, order: str, job, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run ``job`` over ``rows`` arriving in several waves."""
    folder = _folder(spark, name)
    S.arrive(rows, folder, order, lambda stream: S.started(job(stream), f"{folder}/out", f"{folder}/state", mode))
    return S.written(spark, f"{folder}/out", mode, keys)


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("sha256"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("uri"), F.col("doc_id").alias("ord"),
        F.when(F.col("doc_id") % 10 != 9, "image").alias("kind"), (F.col("n_chars") % 23 != 0).alias("ok"))


def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    _, ruled = VQ._scan_items(spark, sf)
    return _drain(spark, "scan", _items(spark, sf), "ord", lambda items: S.stream_findings(items, ruled), "update", ["sha256"])


def stream_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _drain(spark, "failures", _items(spark, sf), "ord", S.stream_failures, "append")


def stream_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of registered assets, each arriving three times; every hash is attributed once."""
    content = copies(spark, sf).drop("plane", "label").withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    content = content.withColumn("arrival", F.col("content_id") % 97 + F.col("turn") * 50)
    folder = _folder(spark, "attribution")
    known = assets(spark, sf).drop("plane", "label")
    S.arrive(content, folder, "arrival", lambda stream: S.scan_batches(stream.drop("arrival", "turn"), known, f"{folder}/out", f"{folder}/state"))
    return spark.read.parquet(f"{folder}/out").select("content_id", F.col("asset_id"), "basis")


def stream_provenance(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.to_json(F.struct(
        F.col("o_custkey").cast("string").alias("asset_id"), F.col("o_orderstatus").alias("sha256"),
        F.col("o_orderpriority").alias("watermark_id"))).alias("line"))
    return _drain(spark, "provenance", lines, "seq", S.stream_provenance, "update", ["asset_id"]).select("asset_id", "sha256", "watermark_id", "position")


def stream_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Two faces per sampled frame in the same place, told apart by their descriptors; equal to tracking them in one go."""
    rows = two_face_detections(spark, sf)
    return _drain(spark, "tracks", rows, "step", lambda d: S.stream_tracks(d, TrackingRules(iou=0.6)), "append")


def stream_track_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's answer beside tracking in one go: detections seen, and rows that only one of the two has."""
    keys = ["video_id", "segment", "step", "det_ix", "track_id"]
    streamed = stream_tracks(spark, sf).withColumn("s", F.lit(1))
    at_once = paired_tracks(spark, sf).withColumn("b", F.lit(1))
    both = streamed.join(at_once, keys, "full")
    return both.agg(F.count("s").alias("detections"), F.count_if(F.col("s").isNull() | F.col("b").isNull()).alias("differing"))


def stream_scene_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_number"), F.array("value").alias("plane"))
    return _drain(spark, "scenes", rows, "frame_number", lambda f: S.stream_scene_sample(f, SamplingRules(max_frames=1 << 40)), "append")


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The detector hook with a toy model: the share of one letter, on every whole text."""
    model = {"name": "letter-share", "version": "1", "backend": "builtin", "training_dataset": None, "input_size": None}

    def load():
        return lambda frame: pd.DataFrame({"score": frame["text"].str.count("e") / frame["text"].str.len().clip(lower=1), "notes": ""})

    out = plugins.score_with(table(spark, sf, "documents").select("doc_id", "text"), load, model, ["doc_id"], ["text"])
    return out.select("doc_id", F.round("score", 6).alias("score"), F.col("model.name").alias("model"))


def embedded_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The embedder hook with letter counts; unit length is enforced by the library."""
    def load():
        letters = "abcdefgh"
        return lambda frame: [np.array([t.count(c) + 1.0 for c in letters]) for t in frame["text"]]

    out = plugins.embed_with(table(spark, sf, "documents").select("doc_id", "text"), load, ["doc_id"], ["text"])
    return out.select("doc_id", "dim", F.posexplode("vector").alias("pos", "value")).select("doc_id", "dim", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


QUERIES = {f.__name__: f for f in (
    stream_scan, stream_failures, stream_attribution, stream_provenance, stream_tracks, stream_track_checks, stream_scene_samples, scored_documents, embedded_documents)}

ORACLES = {
    "stream_tracks": PAIRED,
    "stream_scan": f"""WITH {VQ._SCAN} SELECT sha256, verdict, level, similarity, 'doc/' || ord AS uri, places FROM found
      WHERE verdict NOT IN ('unrelated', 'inconclusive')""",
    "stream_failures": """SELECT sha256(text) AS sha256, 'doc/' || doc_id AS uri, doc_id AS ord FROM documents WHERE doc_id % 10 <> 9 AND n_chars % 23 = 0""",
    "stream_attribution": f"""WITH {HASHES}, d AS (SELECT a.vec_id AS content_id, b.vec_id AS asset_id, bit_count(xor(a.bits, b.bits)) AS dist
      FROM h a JOIN h b ON a.kind = 'copy' AND b.kind = 'asset'),
      near AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY dist, asset_id) AS rk FROM d)
      SELECT content_id, CASE WHEN content_id % 4 < 2 THEN content_id WHEN 1.0 - dist / 64 >= 0.8125 THEN asset_id END AS asset_id,
      CASE content_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'code' ELSE CASE WHEN 1.0 - dist / 64 >= 0.8125 THEN 'perceptual' END END AS basis
      FROM near WHERE rk = 1""",
    "stream_provenance": """SELECT o_custkey::VARCHAR AS asset_id, arg_max(o_orderstatus, o_orderkey) AS sha256,
      arg_max(o_orderpriority, o_orderkey) AS watermark_id, min(o_orderkey) AS position FROM orders GROUP BY 1""",
    "stream_track_checks": f"WITH {_FRAMES} SELECT 2 * count(*) AS detections, 0::BIGINT AS differing FROM samples WHERE k % 10 > 0",
    "stream_scene_samples": """WITH RECURSIVE n AS (SELECT a.user_id, a.event_id, min(b.event_id) AS following FROM events a JOIN events b
      ON a.user_id = b.user_id AND b.event_id > a.event_id AND abs(b.value - a.value) >= 12 GROUP BY ALL),
      k AS (SELECT user_id, min(event_id) AS event_id, 1::BIGINT AS kept FROM events GROUP BY 1 UNION ALL
      SELECT k.user_id, n.following, kept + 1 FROM k JOIN n ON n.user_id = k.user_id AND n.event_id = k.event_id)
      SELECT user_id AS video_id, event_id AS frame_number, kept FROM k""",
    "scored_documents": """SELECT doc_id, round(len(regexp_replace(text, '[^e]', '', 'g')) / greatest(length(text), 1), 6) AS score,
      'letter-share' AS model FROM documents""",
    "embedded_documents": """WITH c AS (SELECT doc_id, list_transform(string_split('abcdefgh', ''),
      lambda x: length(text) - length(replace(text, x, '')) + 1.0::DOUBLE) AS v FROM documents),
      u AS (SELECT doc_id, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM c)
      SELECT doc_id, 8 AS dim, unnest(range(8))::INT AS pos, round(unnest(v)::FLOAT::DOUBLE, 6) AS value FROM u""",
}
