"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "match_decisions", "identity_templates", "leave_one_out_scores", "pair_scores", "roc_points", "calibrated_thresholds",
    "exact_duplicates", "perceptual_matches", "source_attribution", "verdicts", "scan_report", "uniform_samples", "frame_trimmed_mean",
    "face_tracks", "page_edges", "lineage_roots", "identity_components", "vote_tally", "phase_tally", "robustness_rates",
    "layered_mark_cells", "detector_report", "ssim_pairs", "provenance_latest",
]


def main() -> None:
    from sightline.catalog import queries
    from sightline.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
                                                        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    known = queries()
    # Start the Python workers and the code cache before the clock does.
    known["page_edges"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
