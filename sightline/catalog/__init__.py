"""Registered queries with their DuckDB oracles, by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ["identity", "calibration", "provenance", "verdicts", "video", "web", "planes", "marks", "evaluation", "streams", "records"]

# Counters whose integer width differs between the engines: the oracle is cast to the query's type.
WIDTHS = {
    "identity_templates": {"pos": "INTEGER"}, "embedding_redaction": {"dim": "INTEGER"}, "closest_assets": {"rank": "INTEGER"},
    "restore_sizes": {"rank": "INTEGER", "asset_width": "INTEGER", "asset_height": "INTEGER"},
    "track_evidence": {"track_id": "BIGINT"}, "track_representatives": {"track_id": "BIGINT"},
    "scoring_budget": {"track_id": "BIGINT", "turn": "INTEGER"}, "still_sightings": {"rank": "INTEGER"},
    "appearance_histograms": {"slot": "INTEGER"}, "content_region": {c: "INTEGER" for c in ("x1", "y1", "x2", "y2")},
    "vote_tally": {"bit": "INTEGER"}, "phase_tally": {"phase": "INTEGER", "bit": "INTEGER"}, "grid_ranking": {"rank": "INTEGER"},
}


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for topic in TOPICS:
        merged.update(getattr(import_module(f"sightline.catalog.{topic}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    merged = _collect("ORACLES")
    for name, columns in WIDTHS.items():
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
        merged[name] = f"SELECT * REPLACE ({casts}) FROM ({merged[name]})"
    return merged
