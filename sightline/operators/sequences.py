"""Frames and tracks of videos.

Neighbouring frames meet by equi-joins on (video, frame), not in a window over a whole video, and
order-dependent folds run chunk by chunk, so one long video is work for many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.boxes import frontality
from sightline.operators.attribution import closest_hashes, similarity_of
from sightline.operators.blocks import fold_sorted
from sightline.operators.prefix import bucketed_rank, running_sums
from sightline.session import cut_lineage
from sightline.settings import EVIDENCE_FLOOR, SamplingRules, TrackingRules

CHUNK_FRAMES = 4096
MIN_STILL_SIDE = 64
MAX_ASSETS_READ = 3
MAX_SCORED_FACES = 8


def sampling_stride(fps: Column, frame_count: Column, rules: SamplingRules = SamplingRules()) -> Column:
    """Frames between samples; widened so that a long video is covered within the frame budget."""
    rate = F.when(fps > 0, fps).otherwise(F.lit(rules.default_fps))
    stride = F.greatest(F.lit(1), F.rint(rate / rules.fps).cast("bigint"))
    too_long = (frame_count > 0) & (F.ceil(frame_count / stride) > rules.max_frames)
    return F.when(too_long, F.ceil(frame_count / rules.max_frames)).otherwise(stride).cast("bigint")


def sample_uniform(frames: DataFrame, videos: DataFrame, rules: SamplingRules = SamplingRules()) -> DataFrame:
    """Every ``stride``-th frame, at most ``max_frames``; the sample's number needs no window."""
    stride = sampling_stride(F.col("fps"), F.col("frame_count"), rules)
    rate = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(rules.default_fps))
    meta = videos.select("video_id", stride.alias("stride"), rate.alias("rate"))
    step = F.floor(F.col("frame_number") / F.col("stride")).cast("bigint")
    kept = (F.col("frame_number") % F.col("stride") == 0) & (step < rules.max_frames)
    return frames.join(meta, "video_id").where(kept).withColumns(
        {"step": step, "ts": F.col("frame_number") / F.col("rate")}).drop("stride", "rate")


def sample_scene_change(frames: DataFrame, rules: SamplingRules = SamplingRules(), chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """First frame, then each frame differing enough from the *last kept* one, at most ``max_frames``.

    The fold is sequential, yet forgets: chunks first run on their own, then again with the last
    frame their predecessor kept, until no chunk is handed another frame than before. Most chunks
    settle in the second round; the result equals the plain fold.
    """
    work = cut_lineage(frames.select("video_id", "frame_number", F.col("plane").cast("array<double>").alias("plane"),
                                     F.floor(F.col("frame_number") / chunk_frames).cast("bigint").alias("chunk"))
                       .repartition("video_id", "chunk"))
    key = ["video_id", "chunk"]
    video_type = dict(work.dtypes)["video_id"]

    class Chunk:
        """The frame last kept while a chunk's frames go by; its first row is the frame handed to it."""

        def __init__(self):
            self.given, self.last, self.plane = None, None, None

        def take(self, row: tuple) -> bool:
            """Whether a frame is kept."""
            _, _, number, plane, given, handed = row
            if handed:
                self.given = self.last = given
                self.plane = None if plane is None else np.asarray(plane)
                return False
            here = np.asarray(plane)
            keep = self.plane is None or float(np.mean(np.abs(here - self.plane))) >= rules.scene_change
            if keep:
                self.last, self.plane = number, here
            return keep

    def advance(chunk: Chunk, rows: list[tuple]) -> list[tuple]:
        news = [row for row in rows if chunk.take(row) or row[5]]
        return [(*row[:2], chunk.given, chunk.last, None if chunk.plane is None else chunk.plane.tolist()) for row in news[-1:]]

    def emit(chunk: Chunk, rows: list[tuple]) -> list[tuple]:
        return [(row[0], row[2], row[1]) for row in rows if chunk.take(row)]

    def with_handed(todo: DataFrame) -> DataFrame:
        rows = work.join(todo.select(*key), key, "left_semi").select(
            *key, "frame_number", "plane", F.lit(None).cast("bigint").alias("given"), F.lit(False).alias("handed"))
        first = todo.select(*key, F.lit(-1).cast("bigint").alias("frame_number"), "plane", "given", F.lit(True).alias("handed"))
        return rows.unionByName(first).select("video_id", "chunk", "frame_number", "plane", "given", "handed")

    def run(todo: DataFrame) -> DataFrame:
        # a chunk reports what it was handed and each frame it keeps; the last report is its outcome
        reports = fold_sorted(with_handed(todo), key, ["frame_number"], Chunk, advance,
                              f"video_id {video_type}, chunk bigint, given bigint, last bigint, last_plane array<double>")
        return reports.groupBy(*key).agg(F.first("given").alias("given"), F.max(F.struct("last", "last_plane")).alias("r")).select(
            *key, "given", "r.last", "r.last_plane")

    chunks = work.select(*key).distinct()
    nothing = chunks.select(*key, F.lit(-1).cast("bigint").alias("given"), F.lit(None).cast("array<double>").alias("plane"))
    # chunk numbers may have holes: the predecessor is the previous chunk that exists
    order = Window.partitionBy("video_id").orderBy("chunk")
    links = cut_lineage(chunks.withColumn("previous", F.lag("chunk").over(order)).where("previous IS NOT NULL"))
    done = cut_lineage(run(nothing))
    while True:
        handed = links.join(done.select("video_id", F.col("chunk").alias("previous"), F.col("last").alias("given"),
                                        F.col("last_plane").alias("plane")), ["video_id", "previous"]).drop("previous")
        had = done.select(*key, F.col("given").alias("had"))
        changed = cut_lineage(handed.join(had, key).where("given <> had").drop("had"))
        if changed.isEmpty():
            break
        done = cut_lineage(done.join(changed.select(*key), key, "left_anti").unionByName(run(changed)))
    final = handed.unionByName(nothing.join(links.select(*key), key, "left_anti"))
    kept = fold_sorted(with_handed(final), key, ["frame_number"], Chunk, emit, f"video_id {video_type}, frame_number bigint, chunk bigint")
    ranked = bucketed_rank(kept, ["video_id"], F.col("chunk"), [F.col("frame_number")], "kept")
    return ranked.where(F.col("kept") <= rules.max_frames).drop("chunk")


def plane_change(a: Column, b: Column) -> Column:
    """Mean absolute difference of two planes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def scene_cut(frames: DataFrame, cut: float = 12.0) -> DataFrame:
    """Per video the first frame after the largest jump between neighbours, if any reaches ``cut``."""
    before = frames.select("video_id", (F.col("step") + 1).alias("step"), F.col("plane").alias("before"))
    jumps = frames.join(before, ["video_id", "step"]).select(
        "video_id", "step", plane_change(F.col("plane"), F.col("before")).alias("jump"))
    best = jumps.where(F.col("jump") >= cut).groupBy("video_id").agg(
        F.max(F.struct("jump", (-F.col("step")).alias("first"))).alias("m"))
    return best.select("video_id", (-F.col("m.first")).alias("step"), F.col("m.jump").alias("jump"))


def _iou(a: tuple, b: tuple) -> float:
    wide = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    high = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - wide * high
    return wide * high / union if union > 0 else 0.0


def _likeness(a, b) -> float:
    return 1.0 if a is None or b is None else float(np.minimum(a, b).sum())


class OpenTracks:
    """Tracks still open while the steps of one video go by; shared by the batch and the stream."""

    def __init__(self, rules: TrackingRules, next_id: int = 0, tracks: list | None = None):
        self.rules, self.next_id, self.tracks = rules, next_id, tracks or []

    def step(self, step: int, boxes: list[tuple], looks: list) -> list[int]:
        """Track id of each detection of one step."""
        self.tracks = [t for t in self.tracks if step - t["seen"] <= self.rules.max_gap]
        ids: list[int | None] = [None] * len(boxes)
        for track in self.tracks:
            best, chosen = -1.0, None
            for i, taken in enumerate(ids):
                if taken is not None:
                    continue
                overlap, alike = _iou(track["box"], boxes[i]), _likeness(track["look"], looks[i])
                if overlap >= self.rules.iou and alike >= self.rules.appearance and overlap * alike > best:
                    best, chosen = overlap * alike, i
            if chosen is not None:
                ids[chosen] = track["id"]
                track.update(box=boxes[chosen], look=looks[chosen], seen=step)
        for i, taken in enumerate(ids):
            if taken is None:
                ids[i] = self.next_id
                self.tracks.append({"id": self.next_id, "box": boxes[i], "look": looks[i], "seen": step})
                self.next_id += 1
        return ids


def track_faces(detections: DataFrame, rules: TrackingRules = TrackingRules()) -> DataFrame:
    """Greedy association of sampled detections to tracks: adds ``track_id`` (from 0 per segment).

    ``detections(video_id, step, det_ix, x1, y1, x2, y2[, descriptor])`` come from sampled frames, of
    which a video has at most the sampler's budget with at most the detector's face limit each. A gap
    longer than ``max_gap`` closes every track, so a video falls into independent ``segment``s there;
    (segment, track_id) names a track.
    """
    has_look = "descriptor" in detections.columns
    steps = detections.select("video_id", "step").distinct()
    order = Window.partitionBy("video_id").orderBy("step")
    opened = (F.col("step") - F.lag("step").over(order) > rules.max_gap).cast("int")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    segments = steps.withColumn("o", F.coalesce(opened, F.lit(0))).withColumn("segment", F.sum("o").over(running)).drop("o")
    work = detections.join(segments, ["video_id", "step"]).select(
        "video_id", "segment", F.col("step").cast("bigint").alias("step"), "det_ix", "x1", "y1", "x2", "y2",
        *(["descriptor"] if has_look else []))
    video_type, det_type = dict(detections.dtypes)["video_id"], dict(detections.dtypes)["det_ix"]

    def follow(tracks: OpenTracks, rows: list[tuple]) -> list[tuple]:
        ids = tracks.step(rows[0][2], [r[4:8] for r in rows], [r[8] if has_look else None for r in rows])
        return [(*r[:4], i) for r, i in zip(rows, ids)]

    found = fold_sorted(work, ["video_id", "segment"], ["step", "det_ix"], lambda: OpenTracks(rules), follow,
                        f"video_id {video_type}, segment bigint, step bigint, det_ix {det_type}, track_id bigint")
    return detections.join(found, ["video_id", "step", "det_ix"])


TRACK = ["video_id", "segment", "track_id"]


def representative(track_faces: DataFrame, criterion: str = "confidence") -> DataFrame:
    """Best face of each track by confidence, frontality or sharpness; the first among equals."""
    score = {"confidence": lambda: F.col("confidence"), "frontality": lambda: frontality(F.col("landmarks")),
             "sharpness": lambda: F.col("sharpness")}[criterion]()
    order = F.struct(score.alias("s"), (-F.col("step")).alias("first"))
    return track_faces.groupBy(*TRACK).agg(F.max_by("step", order).alias("step"), F.max(score).alias("score"))


def track_evidence(track_faces: DataFrame) -> DataFrame:
    """Per track: length, time span, strongest face and its decision.

    ``track_faces`` carries ``step, ts, user_id, similarity, decision, is_candidate`` per face.
    """
    top = F.max_by(F.struct("step", "user_id", "similarity", "decision", "is_candidate"),
                   F.when(F.col("similarity").isNotNull(), F.struct("similarity", -F.col("step"))))
    out = track_faces.groupBy(*TRACK).agg(F.count("*").alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), top.alias("t"))
    return out.select(*TRACK, "frames", "first_ts", "last_ts", F.col("t.step").alias("identity_step"), F.col("t.user_id").alias("user_id"),
                      F.col("t.similarity").alias("similarity"), F.col("t.decision").alias("decision"),
                      F.coalesce("t.is_candidate", F.lit(False)).alias("is_candidate"))


def video_identity(tracks: DataFrame) -> DataFrame:
    """Per video: tracks, gated tracks and the strongest track (the first among equals)."""
    top = F.max_by(F.struct("user_id", "similarity", "decision", "is_candidate"),
                   F.when(F.col("similarity").isNotNull(), F.struct("similarity", -F.col("segment"), -F.col("track_id"))))
    out = tracks.groupBy("video_id").agg(
        F.count("*").alias("tracks"), F.count_if(~F.col("is_candidate") & F.col("similarity").isNotNull()).alias("gated_tracks"), top.alias("t"))
    return out.select("video_id", "tracks", "gated_tracks", F.col("t.user_id").alias("best_user"), F.col("t.similarity").alias("best_similarity"),
                      F.col("t.decision").alias("best_decision"))


def scoring_budget(track_faces: DataFrame, budget: int = MAX_SCORED_FACES) -> DataFrame:
    """Faces worth scoring: candidate tracks only, candidate faces first, at most ``budget`` a track."""
    strongest = track_evidence(track_faces).where("is_candidate").select(*TRACK)
    order = Window.partitionBy(*TRACK).orderBy(F.col("is_candidate").desc(), "step")
    return (track_faces.join(strongest, TRACK, "left_semi").withColumn("turn", F.row_number().over(order))
            .where(F.col("turn") <= budget))


def still_sightings(frames: DataFrame, assets: DataFrame, floor: float = EVIDENCE_FLOOR, keep: int = MAX_ASSETS_READ) -> DataFrame:
    """Registered photographs shown in a video: the best frame per asset, the best ``keep`` assets.

    ``frames(video_id, step, phash, side)``; frames whose lit region is smaller than 64 pixels do not
    count. An asset among a video's best is among the best of its own best frame, so every distinct
    frame hash needs only its nearest ``keep`` registered hashes.
    """
    usable = frames.where(F.col("side") >= MIN_STILL_SIDE)
    near = closest_hashes(usable, assets, keep, floor=floor).select("phash", F.explode("near").alias("c")).select(
        "phash", F.col("c.asset_phash").alias("asset_phash"), similarity_of(F.col("c.distance"), F.col("phash")).alias("similarity"))
    near = near.where(F.col("similarity") >= floor)
    inside = Window.partitionBy("phash").orderBy("asset_id")
    named = (assets.where(F.col("phash").isNotNull()).withColumn("rk", F.row_number().over(inside)).where(F.col("rk") <= keep)
             .select(F.col("phash").alias("asset_phash"), "asset_id"))
    firsts = usable.groupBy("video_id", "phash").agg(F.min("step").alias("step"))
    seen = firsts.join(near, "phash").join(named, "asset_phash")
    best = seen.groupBy("video_id", "asset_id").agg(F.min(F.struct((-F.col("similarity")).alias("loss"), "step")).alias("m"))
    order = Window.partitionBy("video_id").orderBy("m.loss", "asset_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select(
        "video_id", "rank", "asset_id", (-F.col("m.loss")).alias("similarity"), F.col("m.step").alias("step"))


def still_evidence(sightings: DataFrame, readings: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset a video is attributed to: a mark code read at a sighting outranks resemblance.

    ``readings(video_id, asset_id, code)`` are marks recovered where an asset was seen; a code names
    its own asset, which may be another copy than the closest one.
    """
    codes = assets.where(F.col("watermark_code").isNotNull()).groupBy("watermark_code").agg(F.min("asset_id").alias("marked"))
    read = sightings.join(readings.select("video_id", "asset_id", F.col("code").alias("watermark_code")), ["video_id", "asset_id"], "left").join(
        codes, "watermark_code", "left")
    out = read.groupBy("video_id").agg(
        F.min_by("marked", F.when(F.col("marked").isNotNull(), F.col("rank"))).alias("marked"),
        F.min_by(F.struct("asset_id", "similarity"), "rank").alias("first"))
    return out.select("video_id", F.coalesce("marked", F.col("first.asset_id")).alias("asset_id"),
                      F.when(F.col("marked").isNotNull(), "code").otherwise("perceptual").alias("basis"),
                      F.col("first.similarity").alias("similarity"))


def aggregate_frames(scores: DataFrame, keys: list[str], strategy: str = "trimmed_mean", trim: float = 0.1) -> DataFrame:
    """Per-group score of many frame scores: mean, max, or a mean without the extremes.

    Equal scores are counted first; the trimmed mean then takes from each distinct score the part of
    its count between the trimmed ends, so no group is gathered or sorted in one task.
    """
    if strategy in ("mean", "max"):
        how = F.avg if strategy == "mean" else F.max
        return scores.groupBy(*keys).agg(how("score").alias("score"), F.count("*").alias("frames"))
    if strategy != "trimmed_mean":
        raise ValueError(f"unknown frame aggregation: {strategy}")
    counts = scores.groupBy(*keys, "score").agg(F.count("*").alias("n"))
    up = running_sums(counts, keys, [F.col("score").asc()], {"upto": "n"}, {"frames": "upto"})
    cut = F.when(F.col("frames") < 5, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("frames") * F.lit(trim)))).cast("bigint")
    low = F.greatest(F.col("upto") - F.col("n"), cut)
    high = F.least(F.col("upto"), F.col("frames") - cut)
    used = F.greatest(F.lit(0), high - low)
    return up.groupBy(*keys).agg((F.sum(F.col("score") * used) / F.sum(used)).alias("score"), F.first("frames").alias("frames"))


def spread_indices(total: Column, count: Column) -> Column:
    """``count`` positions evenly spread over ``total``, away from both ends; all when there are no more."""
    none = F.array().cast("array<bigint>")
    spread = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), count.cast("int"))),
        lambda i: F.rint(i * (total - 1) / (count + 1)).cast("bigint")))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), total.cast("int") - 1)), lambda i: i.cast("bigint"))
    return F.when((total <= 0) | (count <= 0), none).when(total <= count, every).otherwise(spread)


def span_coverage(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Sampled frames inside each altered span ``(video_id, span_ix, start_ts, end_ts)``."""
    hit = spans.join(samples.select("video_id", "ts"), "video_id", "left")
    inside = (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts"))
    return hit.groupBy("video_id", "span_ix").agg(F.count_if(inside).alias("sampled"))


def coverage_notes(samples: DataFrame, videos: DataFrame) -> DataFrame:
    """What sampling left unexamined, as facts: how many frames of how many, at which interval, and a tail beyond the budget."""
    first_two = samples.groupBy("video_id").agg(
        F.count("*").alias("sampled"), F.min("ts").alias("t0"), F.min(F.when(F.col("step") == 1, F.col("ts"))).alias("t1"), F.max("ts").alias("last"))
    joined = videos.join(first_two, "video_id")
    interval = F.col("t1") - F.col("t0")
    duration = F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps"))
    between = F.concat(F.format_string("sampled=%d/%d", "sampled", "frame_count"), F.coalesce(F.when(interval.isNotNull(), F.format_string(" interval=%.2fs", interval)), F.lit("")))
    tail = F.when(F.col("last") + F.coalesce(interval, F.lit(0.0)) < duration, F.format_string("unexamined=%.1fs-%.1fs", "last", duration))
    return joined.select("video_id", "sampled", F.array_compact(F.array(between, tail)).alias("limitations"))
