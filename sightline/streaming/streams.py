"""Structured Streaming jobs. What a built-in streaming aggregation can hold stays in the JVM; only the
two order-dependent folds keep custom state.

The reference behaviour has no expiry. Here ``idle`` (processing time) drops the state of videos
that stopped sending, so state is bounded by what is active.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline.operators.attribution import attribute_source
from sightline.operators.sequences import OpenTracks
from sightline.plans.scan import is_flagged
from sightline.settings import SamplingRules, TrackingRules


def stream_findings(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Flagged content of an item stream, once per hash with its first place and the number of places.

    ``items(sha256, uri, kind, ok, ord)``; ``verdicts(sha256, verdict, level, similarity)`` is static. Use
    update mode: a further copy of known content updates its row.
    """
    good = items.where("ok AND kind IS NOT NULL").join(verdicts.where(is_flagged(F.col("verdict"))), "sha256")
    return good.groupBy("sha256", "verdict", "level", "similarity").agg(F.min_by("uri", "ord").alias("uri"), F.count("*").alias("places"))


def stream_failures(items: DataFrame) -> DataFrame:
    """Side output: items that could not be read. A broken file fails at every place it appears."""
    return items.where("kind IS NOT NULL AND NOT ok").select("sha256", "uri", "ord")


def scan_batches(items: DataFrame, assets: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Attribute arriving content against the registry, each hash once; returns the started query.

    The stream's own state knows the hashes of earlier batches, so no batch reads what others wrote. Every micro-batch
    writes its own ``batch=`` folder; a repeated batch overwrites exactly what it wrote before.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        attribute_source(batch, assets).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = items.dropDuplicates(["sha256"]).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_provenance(lines: DataFrame) -> DataFrame:
    """Latest node per asset of an append log ``(seq, line)``, with the sequence it first appeared at."""
    schema = "asset_id STRING, sha256 STRING, parent_asset STRING, watermark_id STRING"
    nodes = lines.select("seq", F.from_json("line", schema).alias("e")).where(F.col("e.asset_id").isNotNull()).select("e.*", "seq")
    return nodes.groupBy("asset_id").agg(
        F.max_by(F.struct("sha256", "parent_asset", "watermark_id"), "seq").alias("node"), F.min("seq").alias("position")).select(
        "asset_id", "node.*", "position")


def _idle(state: GroupState, idle_ms: int | None) -> None:
    if idle_ms:
        state.setTimeoutDuration(idle_ms)


def stream_tracks(detections: DataFrame, rules: TrackingRules = TrackingRules(), idle_ms: int | None = None, lateness: int = 0) -> DataFrame:
    """Track ids for arriving ``detections(video_id, step, det_ix, x1, y1, x2, y2[, descriptor])`` of many videos.

    State per video: the open tracks with their boxes and descriptors (bounded by the faces in view and the gap), segment and
    ids, and the detections of the last ``lateness`` steps. A step is held until the video has shown one ``lateness`` steps later, so what
    arrives out of order within that reach is placed in order. A row without ``det_ix`` ends its video: whatever is held is placed; so does the
    ``idle_ms`` timeout. A detection at or before a step that is already placed comes too late, and is passed on with a NULL track.
    """
    has_look = "descriptor" in detections.columns
    video_type = dict(detections.dtypes)["video_id"]
    output = f"video_id {video_type}, segment bigint, step bigint, det_ix bigint, track_id bigint"
    held_row = "array<struct<step:bigint,det_ix:bigint,box:array<double>,look:array<double>>>"
    state_schema = ("segment bigint, next_id bigint, last_step bigint, newest bigint, ids array<bigint>, seen array<bigint>, boxes array<array<double>>, "
                    f"looks array<array<double>>, held {held_row}")
    floats = lambda values: None if values is None else [float(v) for v in values]

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, next_id, last, newest, tracks, held = 0, 0, None, None, [], []
        if state.exists:
            segment, next_id, last, newest, ids, seen, boxes, looks, held = state.get
            tracks = [{"id": i, "seen": s, "box": tuple(b), "look": None if k is None else np.asarray(k)} for i, s, b, k in zip(ids, seen, boxes, looks)]
            held = [tuple(row) for row in held]
        out, ended = [], state.hasTimedOut
        for rows in () if state.hasTimedOut else batches:
            looks = list(rows["descriptor"]) if has_look else [None] * len(rows)
            boxes = zip(*(rows[c].tolist() for c in ("x1", "y1", "x2", "y2")))
            for step, det, box, look in zip(rows["step"].tolist(), rows["det_ix"].tolist(), boxes, looks):
                if pd.isna(det):
                    ended = True
                elif last is not None and step <= last:
                    out.append((key[0], None, int(step), int(det), None))
                else:
                    held.append((int(step), int(det), floats(box), floats(look)))
                    newest = int(step) if newest is None else max(newest, int(step))
        held.sort(key=lambda row: row[:2])
        open_ = OpenTracks(rules, next_id, tracks)
        done = 0
        while done < len(held) and (ended or held[done][0] <= newest - lateness):
            step = held[done][0]
            until = done
            while until < len(held) and held[until][0] == step:
                until += 1
            part = held[done:until]
            if last is not None and step - last > rules.max_gap:
                segment, open_ = segment + 1, OpenTracks(rules)
            for (_, det, _, _), track in zip(part, open_.step(step, [tuple(row[2]) for row in part], [None if row[3] is None else np.asarray(row[3]) for row in part])):
                out.append((key[0], segment, step, det, track))
            last, done = step, until
        if state.hasTimedOut or ended:
            state.remove()
        else:
            state.update((segment, open_.next_id, last, newest, [t["id"] for t in open_.tracks], [t["seen"] for t in open_.tracks],
                          [floats(t["box"]) for t in open_.tracks], [floats(t["look"]) for t in open_.tracks], held[done:]))
            _idle(state, idle_ms)
        if out:  # a frame costs more than a short video's rows
            video, part, step, det, track = zip(*out)
            yield pd.DataFrame({"video_id": video, "segment": pd.array(part, dtype="Int64"), "step": step, "det_ix": det, "track_id": pd.array(track, dtype="Int64")})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return detections.groupBy("video_id").applyInPandasWithState(follow, output, state_schema, "append", timeout)


def stream_scene_sample(frames: DataFrame, rules: SamplingRules = SamplingRules(), idle_ms: int | None = None) -> DataFrame:
    """Scene-change sampling of arriving frames ``(video_id, frame_number, plane)``; state: the last kept plane."""
    video_type = dict(frames.dtypes)["video_id"]
    output = f"video_id {video_type}, frame_number bigint, kept bigint"

    def sample(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, last = (state.get[0], np.asarray(state.get[1])) if state.exists else (0, None)
        out, numbers, planes = [], [], []
        for batch in batches:
            numbers.extend(batch["frame_number"].tolist())
            planes.extend(batch["plane"])
        for at in np.argsort(np.asarray(numbers, dtype="float64" if None in numbers else None), kind="stable").tolist():
            if kept >= rules.max_frames:
                break
            plane = np.asarray(planes[at])
            if last is None or float(np.abs(plane - last).mean()) >= rules.scene_change:
                kept, last = kept + 1, plane
                out.append((key[0], int(numbers[at]), kept))
        if last is not None:
            state.update((kept, [float(v) for v in last]))
            _idle(state, idle_ms)
        if out:
            yield pd.DataFrame(dict(zip(("video_id", "frame_number", "kept"), zip(*out))))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy("video_id").applyInPandasWithState(sample, output, "kept bigint, plane array<double>", "append", timeout)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Each micro-batch writes its own folder; in update mode the newest row per key counts.
    """
    started(stream, out, checkpoint, mode).awaitTermination()
    return written(stream.sparkSession, out, mode, keys)


def started(stream: DataFrame, out: str, checkpoint: str, mode: str):
    """Begin to write what is available, each micro-batch to its own folder; a repeated batch overwrites what it wrote before."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, out: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream has written to ``out``; in update mode the newest row per key."""
    rows = spark.read.parquet(out)
    if mode == "append":
        return rows.drop("batch")
    fields = [c for c in rows.columns if c not in ("batch", *keys)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*keys, "r.*")


def waves(df: DataFrame, order: str, count: int = 4) -> list[DataFrame]:
    """A table in parts of rising ``order``, cut at its quantiles; rows without an order come last. Every row is in one part."""
    at = F.col(order)
    cuts = sorted(set(df.approxQuantile(order, [i / count for i in range(1, count)], 0.01)))
    lows, highs = [None, *cuts], [*cuts, None]
    parts = []
    for low, high in zip(lows, highs):
        above, below = F.lit(True) if low is None else at > low, F.lit(True) if high is None else at <= high
        parts.append(df.where((above & below) | at.isNull() if high is None else above & below))
    return parts


def arrive(df: DataFrame, folder: str, order: str, start: Callable[[DataFrame], object], count: int = 4) -> None:
    """Let a table arrive in waves of rising ``order``: state has to be carried from one to the next.

    Every task of a wave's plan writes its own files, and one run of ``start(stream)`` (a query over what is available, with a
    checkpoint of its own) takes all of them at once, in many tasks, before the next wave is written. What makes the table runs
    once: it is staged as files, and the quantiles and the waves are read from these.
    """
    spark, path, staged = df.sparkSession, f"{folder}/arrivals", f"{folder}/staged"
    df.write.parquet(staged)
    for wave in waves(spark.read.schema(df.schema).parquet(staged), order, count):
        wave.write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()
