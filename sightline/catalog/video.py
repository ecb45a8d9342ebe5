"""Queries on frames and tracks: users as videos, their events in time order as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.catalog.inputs import HASHES, assets, copies, references
from sightline.operators import sequences as S
from sightline.operators.prefix import bucketed_rank
from sightline.plans.videos import analyze_videos
from sightline.session import table
from sightline.settings import SamplingRules, TrackingRules

r6 = lambda name: F.round(name, 6).alias(name)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(F.col("user_id").alias("video_id"), "event_id", "ts", "event_type", "value", "props")
    ranked = bucketed_rank(events, ["video_id"], F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")], "rank")
    return ranked.select("video_id", (F.col("rank") - 1).alias("frame_number"), "event_type", "value",
                         F.get_json_object("props", "$.k").cast("int").alias("k"), F.array("value").alias("plane"))


def videos(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("user_id")
    return table(spark, sf, "events").groupBy(v.alias("video_id")).agg(F.count("*").alias("frame_count")).select(
        "video_id", "frame_count", F.when(F.col("video_id") % 7 == 0, 0.0).otherwise(1.0 + F.col("video_id") % 20).cast("double").alias("fps"))


def uniform_samples(spark: SparkSession, sf: str) -> DataFrame:
    return S.sample_uniform(frames(spark, sf), videos(spark, sf)).select("video_id", "frame_number", "step", r6("ts"), "value")


def scene_change_samples(spark: SparkSession, sf: str) -> DataFrame:
    """No cap: every frame that differs enough is kept."""
    return S.sample_scene_change(frames(spark, sf), SamplingRules(max_frames=1 << 40)).select(
        "video_id", "frame_number", "kept")


def scene_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return S.scene_cut(frames(spark, sf).withColumnRenamed("frame_number", "step"), 12.0).select("video_id", "step", r6("jump"))


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    """One face per sampled frame, drifting with the frame number."""
    sampled = S.sample_uniform(frames(spark, sf), videos(spark, sf))
    x, y = F.col("k") % 7 * 4, F.col("step") % 5 * 3
    return sampled.select("video_id", "step", "ts", F.lit(0).cast("bigint").alias("det_ix"), x.cast("double").alias("x1"),
                          y.cast("double").alias("y1"), (x + 30).cast("double").alias("x2"), (y + 30).cast("double").alias("y2"),
                          "value", "k").where("k % 10 > 0")


def two_face_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Two faces of different people at one place of every sampled frame; which comes first changes with the step."""
    one = _detections(spark, sf).select("video_id", "step", "x1", "y1", "x2", "y2")
    look = lambda who: F.array(*[F.when(F.lit(i) == who, 1.0).otherwise(0.0) for i in range(2)])
    return one.withColumn("det_ix", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>"))).withColumn(
        "descriptor", look((F.col("det_ix") + F.col("step")) % 2)).select("video_id", "step", "det_ix", "x1", "y1", "x2", "y2", "descriptor")


def paired_tracks(spark: SparkSession, sf: str) -> DataFrame:
    out = S.track_faces(two_face_detections(spark, sf), TrackingRules(iou=0.6))
    return out.select("video_id", "segment", "step", "det_ix", "track_id")


def face_tracks(spark: SparkSession, sf: str) -> DataFrame:
    out = S.track_faces(_detections(spark, sf), TrackingRules(iou=0.6))
    return out.select("video_id", "segment", "step", "det_ix", "track_id")


def _track_faces(spark: SparkSession, sf: str) -> DataFrame:
    """Faces already tracked: the property value names the track, the event value gives the similarity."""
    return frames(spark, sf).select(
        "video_id", F.lit(0).cast("bigint").alias("segment"), (F.col("k") % 4).cast("bigint").alias("track_id"),
        F.col("frame_number").alias("step"), (F.col("frame_number") / 2.0).alias("ts"),
        F.concat(F.lit("user-"), F.col("k") % 3).alias("user_id"), (F.col("value") / 200.0).alias("similarity"),
        F.when(F.col("value") >= 94, "high_confidence").when(F.col("value") >= 71.82, "candidate").otherwise("no_match").alias("decision"),
        (F.col("value") >= 71.82).alias("is_candidate"), (F.col("value") % 1.0).alias("confidence"))


def track_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return S.track_evidence(_track_faces(spark, sf)).select(
        "video_id", "track_id", "frames", "first_ts", "last_ts", "identity_step", "user_id", r6("similarity"), "decision", "is_candidate")


def video_identity(spark: SparkSession, sf: str) -> DataFrame:
    return S.video_identity(S.track_evidence(_track_faces(spark, sf))).select(
        "video_id", "tracks", "gated_tracks", "best_user", r6("best_similarity"), "best_decision")


def track_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return S.representative(_track_faces(spark, sf)).select("video_id", "track_id", "step", r6("score"))


def scoring_budget(spark: SparkSession, sf: str) -> DataFrame:
    return S.scoring_budget(_track_faces(spark, sf)).select("video_id", "track_id", "step", "turn", "is_candidate")


def frame_trimmed_mean(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("score"))
    return S.aggregate_frames(scores, ["user_id", "event_type"]).select("user_id", "event_type", r6("score"), "frames")


def _still_frames(spark: SparkSession, sf: str) -> DataFrame:
    return copies(spark, sf).select((F.col("content_id") % 25).alias("video_id"), F.floor(F.col("content_id") / 25).alias("step"),
                                    "phash", (60 + F.col("content_id") % 10).alias("side"), "code")


def still_sightings(spark: SparkSession, sf: str) -> DataFrame:
    return S.still_sightings(_still_frames(spark, sf), assets(spark, sf)).select("video_id", "rank", "asset_id", r6("similarity"), "step")


def still_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Marks are readable where the asset's id is one short of a multiple of five."""
    seen = S.still_sightings(_still_frames(spark, sf), assets(spark, sf))
    readings = assets(spark, sf).where("asset_id % 5 = 4").select("asset_id", F.col("watermark_code").alias("code"))
    readings = seen.select("video_id", "asset_id").join(readings, "asset_id")
    return S.still_evidence(seen, readings, assets(spark, sf)).select("video_id", "asset_id", "basis", r6("similarity"))


def spread_positions(spark: SparkSession, sf: str) -> DataFrame:
    return videos(spark, sf).select("video_id", F.posexplode(S.spread_indices(F.col("frame_count"), F.lit(5))).alias("pos", "frame"))


def span_coverage(spark: SparkSession, sf: str) -> DataFrame:
    samples = S.sample_uniform(frames(spark, sf), videos(spark, sf))
    spans = videos(spark, sf).select("video_id", F.posexplode(F.array(F.lit(0.0), F.lit(2.5), F.lit(6.0))).alias("span_ix", "start_ts"))
    return S.span_coverage(samples, spans.withColumn("end_ts", F.col("start_ts") + 3.0))


def coverage_notes(spark: SparkSession, sf: str) -> DataFrame:
    samples = S.sample_uniform(frames(spark, sf), videos(spark, sf))
    return S.coverage_notes(samples, videos(spark, sf)).select("video_id", "sampled", F.array_join("limitations", " ").alias("limitations"))


def video_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's sampled events as a video; faces and stills are borrowed from the embeddings."""
    n = table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("n")).withColumn("one", F.lit(1))
    dets = _detections(spark, sf).withColumn("one", F.lit(1)).join(F.broadcast(n), "one").withColumn(
        "vec_id", (F.col("video_id") * 31 + F.col("k")) % F.col("n")).drop("one", "n")
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    faces = dets.join(vectors, "vec_id").select("video_id", "step", "det_ix", "x1", "y1", "x2", "y2", "ts", "vector", F.lit(64).alias("dim"),
                                               (60 + F.col("k")).cast("double").alias("pixels"), "value")
    stills = copies(spark, sf).select(F.col("content_id").alias("vec_id"), "phash")
    samples = dets.join(stills, "vec_id").select("video_id", "step", "ts", "phash", F.lit(100).alias("side"))
    refs = references(spark, sf).select(F.concat(F.lit("user-"), F.col("user_id")).alias("user_id"), "ref_ix", "vector", "dim")
    nothing = assets(spark, sf).where("watermark_code IS NULL").select(F.col("asset_id").alias("video_id"), "asset_id", F.col("watermark_code").alias("code"))
    scorer = lambda gated: gated.select(*S.TRACK, "step", (F.col("value") % 100 / 100).alias("score"))
    out = analyze_videos(samples, faces, nothing, assets(spark, sf), refs, scorer, videos=videos(spark, sf))
    return out.select("video_id", "subject_user_id", "faces_detected", "gated_tracks", r6("deepfake_score"), "rule", "verdict", "level", F.array_join("limitations", " ").alias("limitations"))


QUERIES = {f.__name__: f for f in (
    uniform_samples, scene_change_samples, scene_cuts, face_tracks, paired_tracks, track_evidence, video_identity, track_representatives,
    scoring_budget, frame_trimmed_mean, still_sightings, still_evidence, spread_positions, span_coverage, coverage_notes, video_evidence)}

_FRAMES = """f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number,
    value, (props->>'$.k')::INT AS k FROM events),
  v AS (SELECT user_id AS video_id, count(*) AS frame_count, CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE 1.0 + user_id % 20 END AS fps
    FROM events GROUP BY 1),
  m AS (SELECT *, CASE WHEN fps > 0 THEN fps ELSE 25.0 END::DOUBLE AS rate, greatest(1, round_even((CASE WHEN fps > 0 THEN fps ELSE 25.0 END)
    / 2.0, 0))::BIGINT AS s0 FROM v),
  st AS (SELECT *, CASE WHEN ceil(frame_count / s0) > 600 THEN ceil(frame_count / 600)::BIGINT ELSE s0 END AS stride FROM m),
  samples AS (SELECT f.*, frame_number // stride AS step, frame_number / rate AS ts FROM f JOIN st USING (video_id)
    WHERE frame_number % stride = 0 AND frame_number // stride < 600)"""
# One square of side 30 per step: an open track takes it if they overlap enough, the earliest first; else a new one begins.
_WALK = f"""{_FRAMES}, dt AS (SELECT video_id, step, k % 7 * 4 AS x, step % 5 * 3 AS y, row_number() OVER (PARTITION BY video_id ORDER BY step) AS rn,
    coalesce(step - lag(step) OVER (PARTITION BY video_id ORDER BY step) > 5, false) AS gap FROM samples WHERE k % 10 > 0),
  ds AS (SELECT *, sum(gap::INT) OVER (PARTITION BY video_id ORDER BY rn)::BIGINT AS segment FROM dt),
  walk AS (SELECT video_id, segment, step, rn, 0::BIGINT AS track_id, step AS born, 1::BIGINT AS next_id,
      [{{'id': 0::BIGINT, 'seen': step, 'x': x, 'y': y, 'born': step}}] AS open FROM ds WHERE rn = 1
    UNION ALL
    SELECT video_id, segment, step, rn, coalesce(hit.id, fresh) AS track_id, coalesce(hit.born, step) AS born, CASE WHEN hit IS NULL THEN fresh + 1 ELSE fresh END AS next_id,
      CASE WHEN hit IS NULL THEN list_append(held, {{'id': fresh, 'seen': step, 'x': x, 'y': y, 'born': step}})
        ELSE list_transform(held, lambda t: CASE WHEN t.id = hit.id THEN {{'id': t.id, 'seen': step, 'x': x, 'y': y, 'born': t.born}} ELSE t END) END AS open
    FROM (SELECT *, list_filter(held, lambda t: greatest(0, 30 - abs(t.x - x)) * greatest(0, 30 - abs(t.y - y))
          >= 0.6 * (1800 - greatest(0, 30 - abs(t.x - x)) * greatest(0, 30 - abs(t.y - y))))[1] AS hit
      FROM (SELECT d.*, CASE WHEN d.segment > w.segment THEN 0 ELSE w.next_id END AS fresh,
          CASE WHEN d.segment > w.segment THEN [] ELSE list_filter(w.open, lambda t: d.step - t.seen <= 5) END AS held
        FROM walk w JOIN ds d ON d.video_id = w.video_id AND d.rn = w.rn + 1) a) b)"""
# Two people at one place share every box, so their tracks come in pairs; who came first when a pair began has the lower number.
PAIRED = f"""WITH RECURSIVE {_WALK} SELECT video_id, segment, step, det_ix, 2 * track_id + ((det_ix + step) % 2 <> born % 2)::BIGINT AS track_id
  FROM walk, (SELECT unnest([0::BIGINT, 1::BIGINT]) AS det_ix) two"""
_TRACKS = """f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value,
    (props->>'$.k')::INT AS k FROM events),
  t AS (SELECT video_id, k % 4 AS track_id, step, step / 2.0 AS ts, 'user-' || (k % 3) AS user_id, value / 200.0 AS similarity,
    CASE WHEN value >= 94 THEN 'high_confidence' WHEN value >= 71.82 THEN 'candidate' ELSE 'no_match' END AS decision,
    value >= 71.82 AS is_candidate, value % 1.0::DOUBLE AS confidence FROM f),
  e AS (SELECT video_id, track_id, count(*) AS frames, min(ts) AS first_ts, max(ts) AS last_ts FROM t GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY similarity DESC, step) AS rn FROM t)"""
_SEEN = f"""{HASHES}, c AS (SELECT vec_id % 25 AS video_id, vec_id // 25 AS step, bits, vec_id FROM h WHERE kind = 'copy' AND vec_id % 10 >= 4),
  d AS (SELECT video_id, step, a.vec_id AS asset_id, bit_count(xor(c.bits, a.bits)) AS dist FROM c JOIN h a ON a.kind = 'asset'
    AND bit_count(xor(c.bits, a.bits)) <= 12),
  s AS (SELECT video_id, asset_id, min(dist) AS dist, arg_min(step, dist * 10000 + step) AS step FROM d GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY dist, asset_id) AS rank FROM s),
  seen AS (SELECT video_id, rank, asset_id, 1.0 - dist / 64 AS similarity, step FROM r WHERE rank <= 3)"""

ORACLES = {
    "face_tracks": f"WITH RECURSIVE {_WALK} SELECT video_id, segment, step, 0::BIGINT AS det_ix, track_id FROM walk",
    "paired_tracks": PAIRED,
    "uniform_samples": f"WITH {_FRAMES} SELECT video_id, frame_number, step, round(ts, 6) AS ts, value FROM samples",
    "scene_change_samples": f"""WITH RECURSIVE {_FRAMES}, nxt AS (SELECT a.video_id, a.frame_number, min(b.frame_number) AS following
      FROM f a JOIN f b ON a.video_id = b.video_id AND b.frame_number > a.frame_number AND abs(b.value - a.value) >= 12 GROUP BY ALL),
      kept AS (SELECT video_id, 0::BIGINT AS frame_number, 1::BIGINT AS kept FROM v UNION ALL
      SELECT k.video_id, n.following, k.kept + 1 FROM kept k JOIN nxt n ON n.video_id = k.video_id AND n.frame_number = k.frame_number)
      SELECT video_id, frame_number, kept FROM kept""",
    "scene_cuts": f"""WITH {_FRAMES}, j AS (SELECT video_id, frame_number AS step, abs(value - lag(value) OVER (PARTITION BY video_id
      ORDER BY frame_number)) AS jump FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY jump DESC, step) AS rn
      FROM j WHERE jump >= 12) SELECT video_id, step, round(jump, 6) AS jump FROM r WHERE rn = 1""",
    "track_evidence": f"""WITH {_TRACKS} SELECT e.video_id, e.track_id, frames, first_ts, last_ts, step AS identity_step, user_id,
      round(similarity, 6) AS similarity, decision, is_candidate FROM e JOIN b ON b.video_id = e.video_id AND b.track_id = e.track_id AND rn = 1""",
    "video_identity": f"""WITH {_TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY similarity DESC, track_id) AS k
      FROM b WHERE rn = 1) SELECT video_id, count(*) AS tracks, count(*) FILTER (WHERE NOT is_candidate) AS gated_tracks,
      max(CASE WHEN k = 1 THEN user_id END) AS best_user, round(max(CASE WHEN k = 1 THEN similarity END), 6) AS best_similarity,
      max(CASE WHEN k = 1 THEN decision END) AS best_decision FROM r GROUP BY video_id""",
    "track_representatives": f"""WITH {_TRACKS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id
      ORDER BY confidence DESC, step) AS k FROM t) SELECT video_id, track_id, step, round(confidence, 6) AS score FROM r WHERE k = 1""",
    "scoring_budget": f"""WITH {_TRACKS}, r AS (SELECT t.*, row_number() OVER (PARTITION BY t.video_id, t.track_id
      ORDER BY t.is_candidate DESC, t.step) AS turn FROM t JOIN b ON b.video_id = t.video_id AND b.track_id = t.track_id AND b.rn = 1
      AND b.is_candidate) SELECT video_id, track_id, step, turn, is_candidate FROM r WHERE turn <= 8""",
    "frame_trimmed_mean": """WITH r AS (SELECT user_id, event_type, value, count(*) OVER w AS n, row_number() OVER (PARTITION BY user_id,
      event_type ORDER BY value) AS rn FROM events WINDOW w AS (PARTITION BY user_id, event_type)),
      k AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE greatest(1, floor(n * 0.1)) END AS cut FROM r)
      SELECT user_id, event_type, round(avg(value), 6) AS score, any_value(n) AS frames FROM k WHERE rn > cut AND rn <= n - cut GROUP BY ALL""",
    "still_sightings": f"WITH {_SEEN} SELECT video_id, rank, asset_id, round(similarity, 6) AS similarity, step FROM seen",
    "still_evidence": f"""WITH {_SEEN} SELECT video_id, coalesce(arg_min(CASE WHEN asset_id % 5 = 4 THEN asset_id END,
      CASE WHEN asset_id % 5 = 4 THEN rank END), arg_min(asset_id, rank)) AS asset_id,
      CASE WHEN bool_or(asset_id % 5 = 4) THEN 'code' ELSE 'perceptual' END AS basis,
      round(arg_min(similarity, rank), 6) AS similarity FROM seen GROUP BY video_id""",
    "spread_positions": """WITH v AS (SELECT user_id AS video_id, count(*) AS n FROM events GROUP BY 1),
      p AS (SELECT DISTINCT video_id, CASE WHEN n <= 5 THEN i - 1 ELSE round_even(i * (n - 1) / 6, 0)::BIGINT END AS frame
      FROM v, range(1, 6) t(i) WHERE n > 5 OR i <= n)
      SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1)::INT AS pos, frame FROM p""",
    "span_coverage": f"""WITH {_FRAMES}, spans(span_ix, a) AS (VALUES (0, 0.0::DOUBLE), (1, 2.5), (2, 6.0)) SELECT v.video_id, span_ix,
      count(*) FILTER (WHERE ts >= a AND ts < a + 3.0) AS sampled FROM v CROSS JOIN spans LEFT JOIN samples s ON s.video_id = v.video_id
      GROUP BY ALL""",
    "coverage_notes": f"""WITH {_FRAMES}, k AS (SELECT video_id, count(*) AS n, min(ts) AS t0, min(CASE WHEN step = 1 THEN ts END) AS t1,
      max(ts) AS last FROM samples GROUP BY 1)
      SELECT video_id, n AS sampled, concat_ws(' ', printf('sampled=%d/%d', n, frame_count) || CASE WHEN t1 IS NOT NULL THEN printf(' interval=%.2fs', t1 - t0) ELSE '' END,
      CASE WHEN fps > 0 AND last + coalesce(t1 - t0, 0) < frame_count / fps THEN printf('unexamined=%.1fs-%.1fs', last, frame_count / fps::DOUBLE) END) AS limitations FROM k JOIN v USING (video_id)""",
}
