"""Verdict situations, scans, captured pages, stores, and streams against their batch versions."""

import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators import facecheck as FC
from sightline.operators import sequences as S
from sightline.plans import scan
from sightline.plans import verdicts as V
from sightline.settings import SamplingRules, ScoreThresholds, TrackingRules
from sightline.sources import manifests, media, registry
from sightline.sources import web as W
from sightline.streaming import streams as ST

BLANK = {"subject_user_id": "me", "identities_compared": True, "faces_detected": 1, "identity_decision": "no_match", "asset_shielded": False,
         "registered_faces_compared": False, "degraded_faces": 0, "deepfake_calibrated": False}
OWN = {"asset_id": "a", "asset_owner": "me", "asset_match_basis": "perceptual"}
FILE = {**OWN, "registered_faces_compared": True, "owner_face_in_original": True, "face_in_registered_file": True}
SHIELD = {**OWN, "asset_shielded": True, "registered_faces_compared": True}
SYNTHETIC = {"deepfake_score": 0.6, "deepfake_calibrated": True}

# situation -> (evidence, verdict, level)
SITUATIONS = {
    "exact bytes": ({**OWN, "asset_match_basis": "exact", "identity_decision": "no_match"}, "own_copy", "low"),
    "own face": ({**OWN, "identity_decision": "high_confidence"}, "own_copy", "low"),
    "own face, synthetic": ({**OWN, **SYNTHETIC, "identity_decision": "high_confidence"}, "own_altered", "high"),
    "own face, uncalibrated score": ({**OWN, "deepfake_score": 0.99, "identity_decision": "high_confidence"}, "own_copy", "low"),
    "owner not enrolled": ({**OWN, "identities_compared": False}, "own_unverified", "medium"),
    "owner never shown": ({**OWN, "owner_face_in_original": False}, "own_copy", "low"),
    "original unknown": ({**OWN, "owner_face_in_original": None}, "own_unverified", "medium"),
    "other face": ({**OWN, "owner_face_in_original": True}, "own_altered", "high"),
    "other face, small and shrunk": ({**OWN, "owner_face_in_original": True, "probe_face_pixels": 50.0, "copy_scale": 0.5}, "own_unverified", "medium"),
    "other face, small at full size": ({**OWN, "owner_face_in_original": True, "probe_face_pixels": 50.0, "copy_scale": 1.0}, "own_altered", "high"),
    "other face, unknown size": ({**OWN, "owner_face_in_original": True, "probe_face_pixels": None}, "own_altered", "high"),
    "weak resemblance": ({**OWN, "owner_face_in_original": True, "identity_decision": "candidate"}, "own_unverified", "medium"),
    "no face left": ({**OWN, "owner_face_in_original": True, "faces_detected": 0}, "own_unverified", "medium"),
    "file: owner kept": ({**FILE, "owner_face_kept": True, "replaced_face_pixels": 200.0}, "own_copy", "low"),
    "file: replaced": ({**FILE, "replaced_face_pixels": 200.0}, "own_altered", "high"),
    "file: replaced small": ({**FILE, "replaced_face_pixels": 60.0}, "own_unverified", "medium"),
    "file: replaced small at full scale": ({**FILE, "replaced_face_pixels": 60.0, "copy_scale": 0.95}, "own_altered", "high"),
    "file: replaced, original unsettled": ({**FILE, "replaced_face_pixels": 200.0, "owner_face_in_original": None}, "own_unverified", "medium"),
    "file: degraded": ({**FILE, "degraded_faces": 1}, "own_unverified", "medium"),
    "file: cropped out": (FILE, "own_unverified", "medium"),
    "shield: kept": ({**SHIELD, "face_in_registered_file": True}, "own_copy", "low"),
    "shield: replaced": ({**SHIELD, "replaced_face_pixels": 200.0}, "own_altered", "high"),
    "shield: not compared": ({**SHIELD, "registered_faces_compared": False}, "own_unverified", "medium"),
    "shield: unknown": ({**SHIELD, "face_in_registered_file": None}, "own_unverified", "medium"),
    "stranger": ({}, "unrelated", "low"),
    "nobody enrolled": ({"identities_compared": False}, "inconclusive", "low"),
    "no face": ({"faces_detected": 0}, "unrelated", "low"),
    "match": ({"identity_decision": "high_confidence"}, "identity_match", "medium"),
    "match, synthetic": ({**SYNTHETIC, "identity_decision": "high_confidence"}, "synthetic_suspected", "high"),
    "match, surely synthetic": ({**SYNTHETIC, "deepfake_score": 0.9, "identity_decision": "high_confidence"}, "synthetic_suspected", "critical"),
    "candidate": ({"identity_decision": "candidate"}, "review", "low"),
    "ambiguous": ({"identity_decision": "ambiguous"}, "review", "low"),
    "somebody else's asset": ({**OWN, "asset_owner": "you", "identity_decision": "high_confidence"}, "identity_match", "medium"),
    "asset, no subject": ({**OWN, "subject_user_id": None}, "unrelated", "low"),
}


def _evidence(spark, rows):
    names = [f.split()[0] for f in V.EVIDENCE_SCHEMA.split(", ")]
    return spark.createDataFrame([(k, *[{**BLANK, **e}.get(n) for n in names]) for k, e in rows], "situation STRING, " + V.EVIDENCE_SCHEMA)


def test_verdict_situations(spark):
    frame = _evidence(spark, [(k, e) for k, (e, _, _) in SITUATIONS.items()])
    got = {r["situation"]: r for r in V.assess(frame, ScoreThresholds()).collect()}
    assert {k: (r["verdict"], r["level"]) for k, r in got.items()} == {k: (v, lv) for k, (_, v, lv) in SITUATIONS.items()}
    assert all(r["explanation"] and len(r["limitations"]) >= 2 for r in got.values())
    assert any("uncalibrated" in t for t in got["own face, uncalibrated score"]["explanation"])
    assert any(t.startswith("owner=") for t in got["somebody else's asset"]["explanation"])


def test_every_combination_has_a_verdict(spark):
    tri = (None, True, False)
    rows = [(str(i), {**OWN, "identities_compared": c, "owner_face_in_original": o, "registered_faces_compared": r, "owner_face_kept": k,
                      "face_in_registered_file": f, "asset_shielded": s})
            for i, (c, o, r, k, f, s) in enumerate(itertools.product((True, False), tri, (True, False), tri, tri, (True, False)))]
    assert V.assess(_evidence(spark, rows)).where("verdict IS NULL OR level IS NULL").count() == 0


def test_subject_face(spark):
    rows = [(1, 0.6, 0.1), (2, 0.6, 0.58), (3, 0.5, 0.6), (4, 0.3, 0.2), (5, 0.6, None), (6, None, 0.9)]
    frame = spark.createDataFrame(rows, "id int, own double, rival double")
    column = V.subject_decision(F.col("own"), F.col("rival"), F.lit(True), F.lit(0.3591), F.lit(0.47), 0.05)
    got = [r["d"] for r in frame.orderBy("id").select(column.alias("d")).collect()]
    assert got == ["high_confidence", "ambiguous", "ambiguous", "no_match", "high_confidence", None]


def test_credentials(spark):
    kind = "supported boolean, present boolean, trusted boolean, verified boolean, issuer string, claim_generator string, reason string, codes array<string>"
    rows = [((False, None, None, None, None, None, None, None),), ((True, False, None, None, None, None, None, None),), ((True, None, None, None, None, None, "bad", None),),
            ((True, True, True, True, "x", None, None, None),), ((True, True, False, True, "x", "y", None, None),), ((True, True, False, False, None, None, None, ["c1"]),)]
    got = [r["t"] for r in spark.createDataFrame(rows, f"c struct<{kind.replace(' ', ':').replace(',:', ',')}>").select(V.describe_credentials(F.col("c")).alias("t")).collect()]
    assert [k in t for k, t in zip(("unchecked", "absent", "reason=bad", "trusted signer=x tool=unknown", "verified signer=x tool=y", "codes=c1"), got)] == [True] * 6


def test_broken_files_fail_at_every_place(spark):
    items = spark.createDataFrame([("h1", "u1", 0, "image", True), ("h1", "u2", 1, "image", True), ("h2", "u3", 2, "image", False), ("h2", "u4", 3, "image", False),
                                   ("h3", "u5", 4, "image", True), (None, "u6", 5, None, True)], "sha256 string, uri string, ord int, kind string, ok boolean").withColumn("found_on", F.lit("x"))
    ruled = spark.createDataFrame([("h1", "own_altered", "high", 0.2), ("h3", "unrelated", "low", None)], "sha256 string, verdict string, level string, similarity double")
    report = scan.scan_report(items, ruled).first().asDict()
    assert report == {"discovered": 6, "not_media": 1, "analysed": 2, "duplicates": 1, "failures": 2, "flagged": 1}
    found = scan.scan_findings(items.where("kind IS NOT NULL"), ruled).collect()
    assert [(r["uri"], r["places"]) for r in found] == [("u1", 2)]


PAGE = """<html><head><base href="/dir/"><meta property="og:image" content="og.jpg"><link rel="image_src" href="src.png"></head><body>
<a href="page.html#x">p</a><a href="mailto:a@b">m</a><a href="photo.JPG">big</a><a href="og.jpg">same</a><a href="https://other.org/z">o</a>
<img src="small.jpg" width="20" height="200"><img src="a.jpg" srcset="a1.jpg 1x, a2.jpg 3x"><img src="b.jpg" srcset="b1.jpg 300w, b2.jpg 800w, b3.jpg 9x">
<picture><source srcset="p1.webp 400w, p2.webp 900w"><img src="p.jpg" alt=""></picture><img src="logo.svg"><img data-src="lazy">
<video src="clip.mp4" poster="poster.png"><source src="alt.webm" type="video/webm"></video></body></html>"""


def test_page_edges(spark):
    pages = spark.createDataFrame([("http://site.org/x/y", PAGE)], "url string, html string")
    got = W.page_edges(pages).orderBy("pos").collect()
    base = "http://site.org/dir/"
    by = lambda edge: [(r["target_url"].replace(base, ""), r["kind"]) for r in got if r["edge"] == edge]
    assert by("page") == [("page.html", None), ("https://other.org/z", None)]
    assert by("linked") == [("photo.JPG", "image")]
    assert by("shown") == [("og.jpg", "image"), ("src.png", "image"), ("a2.jpg", "image"), ("b2.jpg", "image"), ("p2.webp", "image"), ("lazy", "image"),
                           ("clip.mp4", "video"), ("poster.png", "image"), ("alt.webm", "video")]


def _brute_crawl(edges, captured, seed, max_depth, max_pages, max_media):
    host = lambda u: u.split("/")[2]
    queue, queued, seen, read, out = [(seed, 0)], {seed}, set(), 0, []
    while queue and read < max_pages and len(out) < max_media:
        page, depth = queue.pop(0)
        if page not in captured:
            continue
        read += 1
        mine = sorted((e for e in edges if e[0] == page and e[2] != "page"), key=lambda e: (e[2] == "linked", e[4]))
        for e in mine:
            if e[1] not in seen and len(out) < max_media:
                seen.add(e[1])
                out.append((page, e[1], depth))
        if depth < max_depth:
            for e in sorted((e for e in edges if e[0] == page and e[2] == "page"), key=lambda e: e[4]):
                if e[1] not in queued and host(e[1]) == host(seed):
                    queued.add(e[1])
                    queue.append((e[1], depth + 1))
    return out


@pytest.mark.parametrize("limits", [(0, 50, 200), (2, 50, 200), (2, 4, 200), (3, 50, 7), (3, 5, 9)])
def test_crawl_matches_queue(spark, limits):
    rng = random.Random(11)
    urls = [f"http://{'ab'[i % 5 == 0]}.org/{i}" for i in range(25)]
    edges = []
    for u in urls:
        for pos in range(6):
            kind = rng.choice(["page", "page", "shown", "linked"])
            target = rng.choice(urls) if kind == "page" else f"http://m.org/{rng.randrange(30)}.jpg"
            if not any(e[0] == u and e[1] == target for e in edges):
                edges.append((u, target, kind, None if kind == "page" else "image", pos))
    captured = set(urls) - {urls[3], urls[8]}
    e = spark.createDataFrame(edges, "page_url string, target_url string, edge string, kind string, pos int")
    p = spark.createDataFrame([(u,) for u in captured], "url string")
    seeds = [urls[1], urls[2]]
    got = W.crawl_frontier(e, p, spark.createDataFrame([(s,) for s in seeds], "seed string"), *limits).orderBy("seed", "nth").collect()
    for seed in seeds:
        assert [(r["found_on"], r["target_url"], r["depth"]) for r in got if r["seed"] == seed] == _brute_crawl(edges, captured, seed, *limits)


def test_robots(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://a.org/x", "http://a.org/open/x", "http://gone.org/x", "http://down.org/x", "http://new.org/x", "ftp://a.org/x", "http://lan.org/x")], "url string")
    robots = spark.createDataFrame([("http://a.org", 200, 0, True, "/open", 5.0), ("http://a.org", 200, 1, False, "/", 5.0), ("http://gone.org", 404, None, None, None, None),
                                    ("http://down.org", 503, None, None, None, None), ("http://lan.org", 404, None, None, None, None)],
                                   "origin string, status int, rule_pos int, allow boolean, path_prefix string, crawl_delay double")
    hosts = spark.createDataFrame([(h, "93.184.216.34") for h in ("a.org", "gone.org", "down.org", "new.org")] + [("lan.org", "93.184.216.34"), ("lan.org", "192.168.1.4")], "host string, ip string")
    got = {r["url"]: (r["allowed"], r["delay"]) for r in W.url_policy_gate(urls, robots, hosts.withColumn("is_global", W.is_global_address(F.col("ip")))).collect()}
    assert got == {"http://a.org/x": (False, None), "http://a.org/open/x": (True, 5.0), "http://gone.org/x": (True, 1.0), "http://down.org/x": (False, None),
                   "http://new.org/x": (False, None), "ftp://a.org/x": (False, None), "http://lan.org/x": (False, None)}


def test_stores(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join([json.dumps({"asset_id": "a", "sha256": "1"}), "", "{bad", json.dumps({"asset_id": "b", "sha256": "2"}), json.dumps({"asset_id": "a", "sha256": "3"})]))
    got = [(r["asset_id"], r["sha256"]) for r in registry.read_provenance(spark, str(log)).orderBy("position").collect()]
    assert got == [("a", "3"), ("b", "2")]

    folder = tmp_path / "assets"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"asset_id": "a", "user_id": "u"}, indent=1))
    (folder / "b.json").write_text("{broken")
    (folder / "c.json").write_text(json.dumps({"asset_id": "c", "user_id": "v"}))
    assets = registry.assets_table(spark, str(folder))
    assert {r["asset_id"] for r in assets.collect()} == {"a", "c"} and registry.assets_table(spark, str(folder), "u").count() == 1
    assert registry.upsert(assets, assets.where("asset_id = 'a'").withColumn("user_id", F.lit("w")), "asset_id").where("user_id = 'w'").count() == 1

    ids = spark.createDataFrame([("ann/1", 3), ("bob", 3)], "user_id string, image_count int")
    vectors = spark.createDataFrame([("ann/1", 0, [1.0]), ("bob", 0, [1.0])], "user_id string, ref_ix int, vector array<float>")
    registry.save_identities(ids, vectors, str(tmp_path / "ids"))
    loaded, _ = registry.load_identities(spark, str(tmp_path / "ids"), ["bob"])
    assert [r["file_name"] for r in loaded.collect()] == ["ann_1", "bob"]
    with pytest.raises(ValueError, match="not enrolled"):
        registry.load_identities(spark, str(tmp_path / "ids"), ["eve"])
    registry.save_identities(ids, vectors.where("user_id = 'bob'"), str(tmp_path / "orphans"))
    with pytest.raises(ValueError, match="without vectors"):
        registry.load_identities(spark, str(tmp_path / "orphans"))
    assert registry.delete_identity(ids, vectors, "bob")[1].count() == 1

    records = spark.createDataFrame([("f1", "2024-01-01"), ("f2", "2024-02-01")], "source_id string, created_at string")
    registry.evidence_sink(records, str(tmp_path / "evidence"), ["source_id"])
    listed = registry.evidence_read(spark, str(tmp_path / "evidence")).collect()
    assert [r["created_at"] for r in listed] == ["2024-02-01", "2024-01-01"]
    one = registry.evidence_read(spark, str(tmp_path / "evidence"), listed[0]["analysis_id"]).first()
    assert json.loads(one["report"])["source_id"] == "f2"


def test_files_and_results(spark, tmp_path):
    root = tmp_path / "media" / "deep"
    root.mkdir(parents=True)
    for name in ("a.JPG", "b.mp4", "c.txt"):
        (root / name).write_bytes(b"same")
    assert [r["kind"] for r in media.media_manifest(spark, str(tmp_path / "media")).collect()] == ["image", "video"]
    assert media.media_content(spark, str(tmp_path / "media")).select("sha256").distinct().count() == 1
    rows = spark.createDataFrame([(1,)], "x int")
    manifests.results_sink(rows, {"python": "3"}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first()["env_python"] == "3"
    with pytest.raises(ValueError, match="no results"):
        manifests.results_sink(rows.limit(0), {}, str(tmp_path / "none"))
    (tmp_path / "m.json").write_text(json.dumps({"records": [{"path": "x/facefam/1.png", "label": "fake", "identity": "p", "donor": "q"}]}))
    got = manifests.eval_manifest(spark, str(tmp_path / "m.json")).first()
    assert got["family"] == "facefam" and got["people"] == ["p", "q"]


def test_clip_inventory(spark):
    names = ["x/Deepfakes/c23/videos/003_007.mp4", "x/Deepfakes/raw/videos/003_007.mp4", "y/deepfakes_c23/003_007/0001.png", "y/deepfakes_c23/003_007/0002.png",
             "original/c23/frames/011/0001.jpg", "original/c23/frames/011/0002.jpg", "DeepFakes/masks/003_007.mp4", "misc/c23/005.mp4", "Face2Face-c40-012_013.avi",
             "FaceSwap/021_022.mov", "faceswap/c23/notes.txt", "Real/part/1234.mp4", "DeepFakeDetection/c23/031_032.mp4"]
    frame = spark.createDataFrame([(n,) for n in names], "path string")
    row = lambda r: (r["kind"], r["video_id"], r["path"], r["is_video"], r["members"])
    got = {row(r) for r in manifests.clip_inventory(frame).collect()}
    assert got == {("deepfakes", "003_007", names[0], True, 1), ("real", "011", "original/c23/frames/011", False, 2), ("faceswap", "021_022", names[9], True, 1),
                   ("deepfakedetection", "031_032", names[12], True, 1), ("face2face", "012_013", names[8], True, 1)}
    every = {row(r)[:2] for r in manifests.clip_inventory(frame, compression=None, wanted=["face2face"]).collect()}
    assert every == {("face2face", "012_013"), ("real", "011")}


def test_faces_of_a_copy(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    reg = [("a", 0, unit(0), 100.0, 0.9), ("a", 1, unit(1), 80.0, 0.1)]
    schema = "asset_id string, face_ix int, vector array<double>, pixels double, own_score double"
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0, 0, 10, 10))])
    registered = spark.createDataFrame(reg, schema).withColumns({"bbox": box, "width": F.lit(100.0), "height": F.lit(100.0)})
    rows = [(1, 0, unit(0), 50.0, 0.9, None), (1, 1, unit(1), 40.0, 0.1, None), (2, 0, unit(1), 40.0, 0.1, None), (3, 0, unit(2), 90.0, 0.1, 3.0), (4, 0, unit(2), 90.0, 0.1, 1.2), (5, 0, unit(2), 90.0, 0.4, 3.0)]
    copies = spark.createDataFrame(rows, "content_id int, face_ix int, vector array<double>, pixels double, own_score double, change_ratio double").withColumns(
        {"asset_id": F.lit("a"), "bbox": box, "width": F.lit(100.0), "height": F.lit(100.0), "shielded": F.lit(False)})
    got = {r["content_id"]: r for r in FC.registered_face_check(copies, registered).collect()}
    assert got[1]["owner_face_kept"] and got[1]["faces_kept"] and got[1]["face_scale"] == 0.5
    assert got[2]["owner_face_kept"] is False and got[2]["faces_kept"]
    assert got[3]["faces_kept"] is False and got[3]["replaced_face_pixels"] == 90.0 and got[3]["face_scale"] == 1.0
    assert got[4]["faces_kept"] is None and got[4]["faces_degraded"] == 1
    assert got[5]["faces_kept"] is None and got[5]["replaced_face_pixels"] is None


def _file_stream(spark, tmp_path, frame, parts):
    """Write a frame as several ordered files and read them one file per micro-batch."""
    import os
    folder = tmp_path / "in"
    for i, condition in enumerate(parts):
        frame.where(condition).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            path = folder / name
            if name.endswith(".parquet") and not name.startswith("t"):
                path.rename(folder / f"t{i}-{name}")
                os.utime(folder / f"t{i}-{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_stream_tracks_equal_batch(spark, tmp_path):
    rng = random.Random(12)
    rows = [(v, s, i, float(i * 40 + rng.randrange(9)), 0.0, float(i * 40 + 30), 30.0) for v in range(3) for s in [*range(20), *range(30, 40)] for i in range(rng.randrange(3))]
    frame = spark.createDataFrame(rows, "video_id int, step long, det_ix long, x1 double, y1 double, x2 double, y2 double")
    stream = _file_stream(spark, tmp_path, frame, ["step < 7", "step >= 7 AND step < 33", "step >= 33"])
    got = ST.drain(ST.stream_tracks(stream, TrackingRules()), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    columns = ["video_id", "segment", "step", "det_ix", "track_id"]
    as_set = lambda df: {tuple(r) for r in df.select(*columns).collect()}
    assert as_set(got) == as_set(S.track_faces(frame))


def test_stream_scenes_equal_batch(spark, tmp_path):
    rng = random.Random(13)
    rows = [(v, f, [rng.random() * 40]) for v in range(3) for f in range(60)]
    frame = spark.createDataFrame(rows, "video_id int, frame_number long, plane array<double>")
    rules = SamplingRules(max_frames=20)
    stream = _file_stream(spark, tmp_path, frame, ["frame_number < 25", "frame_number >= 25"])
    got = ST.drain(ST.stream_scene_sample(stream, rules), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    as_set = lambda df: {(r["video_id"], r["frame_number"], r["kept"]) for r in df.collect()}
    assert as_set(got) == as_set(S.sample_scene_change(frame, rules, 16))


def test_stream_scan_sees_each_hash_once(spark, tmp_path):
    assets = spark.createDataFrame([("a1", "u", "s1", "0" * 16, None, None)], "asset_id string, user_id string, sha256 string, phash string, watermark_code string, distribution_id string")
    content = spark.createDataFrame([(1, "s1", None, "f" * 16), (2, "s2", None, "0" * 16), (3, "s1", None, "f" * 16), (4, "s3", None, "f" * 16)], "content_id int, sha256 string, code string, phash string")
    stream = _file_stream(spark, tmp_path, content, ["content_id <= 2", "content_id > 2"])
    query = ST.scan_batches(stream, assets, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["sha256"], r["basis"]) for r in got if r["basis"]) == [("s1", "exact"), ("s2", "perceptual")] and len(got) == 3


def test_stream_updates_latest_node(spark, tmp_path):
    line = lambda a, s: json.dumps({"asset_id": a, "sha256": s})
    frame = spark.createDataFrame([(0, line("a", "1")), (1, line("b", "2")), (2, line("a", "3")), (3, "{bad")], "seq long, line string")
    stream = _file_stream(spark, tmp_path, frame, ["seq < 2", "seq >= 2"])
    got = ST.drain(ST.stream_provenance(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update", ["asset_id"])
    assert {r["asset_id"]: (r["sha256"], r["position"]) for r in got.collect()} == {"a": ("3", 0), "b": ("2", 1)}


def test_streamed_tracks_equal_batch_tracks(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for video in range(3):
        for step in range(40):
            for face in range(2):  # the same place, told apart by looks alone
                look = [1.0, 0.0] if face == (step % 2) else [0.0, 1.0]
                x = rng.randrange(0, 8)
                rows.append((video, step + (20 if step > 25 else 0), face, float(x), 0.0, x + 40.0, 40.0, look))
    frame = spark.createDataFrame(rows, "video_id int, step long, det_ix long, x1 double, y1 double, x2 double, y2 double, descriptor array<double>")
    stream = _file_stream(spark, tmp_path, frame, ["step < 13", "step >= 13 AND step < 30", "step >= 30"])
    got = ST.drain(ST.stream_tracks(stream), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    as_set = lambda df: {(r["video_id"], r["segment"], r["step"], r["det_ix"], r["track_id"]) for r in df.collect()}
    assert as_set(got) == as_set(S.track_faces(frame)) and len({r[4] for r in as_set(got) if r[1] == 0}) == 2


def test_late_detections_are_passed_on_without_a_track(spark, tmp_path):
    rows = [(1, 5, 0, 0.0, 0.0, 9.0, 9.0), (1, 3, 0, 0.0, 0.0, 9.0, 9.0), (1, 6, 0, 0.0, 0.0, 9.0, 9.0)]
    frame = spark.createDataFrame(rows, "video_id int, step long, det_ix long, x1 double, y1 double, x2 double, y2 double")
    stream = _file_stream(spark, tmp_path, frame, ["step = 5", "step = 3 OR step = 6"])
    got = ST.drain(ST.stream_tracks(stream), str(tmp_path / "out"), str(tmp_path / "state"), "append")
    assert sorted((r["step"], r["track_id"]) for r in got.collect()) == [(3, None), (5, 0), (6, 0)]


def test_steps_out_of_order_are_held_and_placed(spark, tmp_path):
    """Arrivals shuffled within five steps, some a batch late: held, they get the tracks of the orderly table; one beyond the reach gets none."""
    rng = random.Random(21)
    rows = [(v, s, i, float(i * 40 + rng.randrange(9)), 0.0, float(i * 40 + 30), 30.0) for v in range(3) for s in [*range(24), *range(40, 60)] for i in range(rng.randrange(3))]
    schema = "video_id int, step long, det_ix long, x1 double, y1 double, x2 double, y2 double"
    frame = spark.createDataFrame(rows, schema)
    ends = [(v, 60, None, None, None, None, None) for v in range(3)]
    batch_of = lambda row: min(3, max(0, (row[1] + rng.randrange(-4, 2)) // 15))
    sent = spark.createDataFrame([(*row, batch_of(row)) for row in rows] + [(1, 2, 7, 0.0, 0.0, 9.0, 9.0, 3)] + [(*row, 4) for row in ends], f"{schema}, batch int")
    stream = _file_stream(spark, tmp_path, sent, [f"batch = {i}" for i in range(5)]).drop("batch")
    got = ST.drain(ST.stream_tracks(stream, lateness=6), str(tmp_path / "out"), str(tmp_path / "state"), "append").collect()
    columns = ["video_id", "segment", "step", "det_ix", "track_id"]
    assert [tuple(r[c] for c in columns) for r in got if r["track_id"] is None] == [(1, None, 2, 7, None)]
    assert {tuple(r[c] for c in columns) for r in got if r["track_id"] is not None} == {tuple(r) for r in S.track_faces(frame).select(*columns).collect()}


def test_pages_are_parsed_once(spark):
    from sightline.sources.web import page_edges

    pages = spark.createDataFrame([("http://h/", "<a href='x.jpg'>x</a><img src='x.jpg'>")], "url string, html string")
    plan = page_edges(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_waves_hold_every_row_and_are_written_by_many_tasks(spark, tmp_path):
    frame = spark.range(0, 1000, 1, 6).selectExpr("id", "IF(id % 50 = 0, NULL, id % 97) AS arrival")
    parts = [p.collect() for p in ST.waves(frame, "arrival", 4)]
    assert sorted(r["id"] for p in parts for r in p) == list(range(1000))
    tops = [max(r["arrival"] for r in p if r["arrival"] is not None) for p in parts]
    assert tops == sorted(tops) and sum(r["arrival"] is None for r in parts[-1]) == 20
    seen = []

    def start(stream):
        def note(batch, batch_id):
            seen.append((batch.rdd.getNumPartitions(), batch.count()))

        return stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()

    ST.arrive(frame, str(tmp_path), "arrival", start)
    assert len(seen) == len(parts) and [n for _, n in seen] == [len(p) for p in parts]
    assert len(list((tmp_path / "arrivals").glob("part-*"))) >= 6 * len(parts) - 6


def test_waves_make_their_table_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    one = F.udf(lambda x: made.add(1) or x, "bigint")
    frame = spark.range(40).select(one("id").alias("arrival"))
    ST.arrive(frame, str(tmp_path), "arrival", lambda stream: ST.started(stream, f"{tmp_path}/out", f"{tmp_path}/state", "append"))
    assert ST.written(spark, f"{tmp_path}/out", "append").count() == 40 and made.value == 40


def test_asset_files_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    from sightline.sources import registry
    monkeypatch.setattr(registry, "FILES_A_TASK", 4)
    rows = spark.range(20).select(F.col("id").cast("string").alias("asset_id"), F.lit("u").alias("user_id"))
    registry.assets_sink(rows, f"{tmp_path}/assets")
    files = [f.name for f in (tmp_path / "assets").glob("part-*.json")]
    assert len(files) == 20 and len({f[:10] for f in files}) > 1
    assert sorted(int(r["asset_id"]) for r in registry.assets_table(spark, f"{tmp_path}/assets").collect()) == list(range(20))


def test_models_hold_one_batch_at_a_time(spark):
    from sightline.functions import plugins
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def load():
        import weakref
        alive = weakref.WeakSet()

        class Held:
            def __init__(self):
                self.own = self
                alive.add(self)

        def predict(frame):
            Held()
            return pd.DataFrame({"score": 0.5, "notes": str(len(alive))}, index=frame.index)

        return predict

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        rows = spark.range(0, 300, 1, 1).select("id", F.lit("text").alias("text"))
        notes = plugins.score_with(rows, load, {"name": "toy"}, ["id"], ["text"]).select("notes").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(notes) == 300 and max(int(r["notes"]) for r in notes) <= 2


def test_embedders_hold_one_batch_at_a_time(spark):
    from sightline.functions import plugins
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def load():
        import weakref
        alive = weakref.WeakSet()

        class Held:
            def __init__(self):
                self.own = self
                alive.add(self)

        def embed(frame):
            Held()
            return [[3.0, 4.0] + [0.0] * len(alive)] * len(frame)

        return embed

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        rows = spark.range(0, 300, 1, 1).select("id", F.lit("text").alias("text"))
        made = plugins.embed_with(rows, load, ["id"], ["text"]).select("dim").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(made) == 300 and max(r["dim"] for r in made) <= 4


def test_texts_that_a_model_searched_are_gone_before_the_next_batch(spark):
    from sightline.functions import plugins
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def load():
        import weakref
        searched = []

        def predict(frame):
            alive = sum(column() is not None for column in searched)
            texts = frame["text"]
            searched.append(weakref.ref(texts))
            return pd.DataFrame({"score": texts.str.count("e") / texts.str.len(), "notes": str(alive)})

        return predict

    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        rows = spark.range(0, 300, 1, 1).select("id", F.lit("text").alias("text"))
        found = plugins.score_with(rows, load, {"name": "toy"}, ["id"], ["text"]).select("score", "notes").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == 300 and {(r["score"], r["notes"]) for r in found} == {(0.25, "0")}


@pytest.mark.parametrize("taken", [3, 1])
def test_batches_are_collected_without_walking_what_was_there_before(taken):
    import gc

    from sightline.functions import plugins
    walked = []

    def work(frame):
        walked.append((gc.get_freeze_count(), len(gc.get_objects())))
        return frame

    results = plugins._one_by_one(iter([pd.DataFrame({"a": [i]}) for i in range(3)]), work)
    assert [next(results)["a"].tolist() for _ in range(taken)] == [[i] for i in range(taken)]
    results.close()
    assert len(walked) == taken and all(frozen > walks for frozen, walks in walked) and gc.get_freeze_count() == 0
