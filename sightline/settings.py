"""Immutable settings. They enter plans as literals, never as collected tables."""

from __future__ import annotations

from dataclasses import dataclass

# Shipped decision boundaries and sampling policy.
LEVEL_ORDER = {"low": 0, "medium": 1, "high": 2, "critical": 3}
DECISION_ORDER = {"no_match": 0, "ambiguous": 1, "candidate": 2, "high_confidence": 3}
BASIS_CONFIDENCE = {"exact": 1.0, "code": 0.8, "perceptual": 0.4}
SMALL_FACE_PIXELS = 80
SHRUNK_COPY_SCALE = 0.9
FACE_CHANGE_RATIO = 1.75


@dataclass(frozen=True)
class FaceThresholds:
    candidate: float = 0.3591
    high: float = 0.47
    min_margin: float = 0.05
    quality_penalty: float = 0.0


@dataclass(frozen=True)
class ScoreThresholds:
    suspicious: float = 0.5
    high: float = 0.8
    calibrated: bool = False


@dataclass(frozen=True)
class EnrollmentRules:
    min_images: int = 3
    max_images: int = 10
    min_confidence: float = 0.7
    min_face_pixels: int = 80
    min_sharpness: float = 100.0
    min_sharpness_ratio: float = 0.15


@dataclass(frozen=True)
class SamplingRules:
    fps: float = 2.0
    max_frames: int = 600
    scene_change: float = 12.0
    default_fps: float = 25.0


@dataclass(frozen=True)
class TrackingRules:
    iou: float = 0.4
    appearance: float = 0.75
    max_gap: int = 5


@dataclass(frozen=True)
class GateRules:
    quantile: float = 0.995
    max_false_positive: float = 0.01
    min_recall: float = 0.20
    confidence: float = 0.95


EVIDENCE_FLOOR = 0.8125  # pHash similarity from which a copy counts as resembling an asset
