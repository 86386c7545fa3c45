"""Tunables of the pipeline, in one frozen place."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from hashlib import sha256


@dataclass(frozen=True)
class PipelineParams:
    # The defaults that results are compared at.
    sample_fps: float = 4.0
    tile_size: int = 1280
    tile_overlap: int = 256
    nms_iou: float = 0.4
    detector_score_min: float = 0.6
    min_face_width_px: float = 50.0
    max_abs_yaw_deg: float = 35.0
    max_abs_pitch_deg: float = 25.0
    min_blur: float = 90.0
    min_brightness: float = 40.0
    max_brightness: float = 215.0
    weight_size: float = 0.4
    weight_blur: float = 0.3
    weight_frontal: float = 0.3
    pose_split_deg: float = 15.0
    photos_per_pose: int = 3
    max_photos: int = 8
    min_photos: int = 5
    eps: float = 0.42
    min_samples: int = 3
    merge_factor: float = 1.3
    merge_overlap: float = 0.3
    split_span: float = 0.6
    split_tightness: float = 0.5
    split_factor: float = 0.7
    match_threshold: float = 0.38
    match_margin: float = 0.05
    match_band: float = 0.08
    health_poor_coverage: float = 60.0
    health_fair_coverage: float = 85.0
    health_min_similarity: float = 0.45
    retention_days: int = 180


#: Stages in order, and the parameters that each depends on besides all earlier ones.
STAGES = {
    "extract": ("sample_fps",),
    "detect": ("tile_size", "tile_overlap", "nms_iou", "detector_score_min"),
    "quality": ("min_face_width_px", "max_abs_yaw_deg", "max_abs_pitch_deg", "min_blur", "min_brightness", "max_brightness", "weight_size", "weight_blur", "weight_frontal"),
    "cluster": ("eps", "min_samples", "merge_factor", "merge_overlap", "split_span", "split_tightness", "split_factor"),
    "match": ("match_threshold", "match_margin", "match_band", "health_poor_coverage", "health_fair_coverage", "health_min_similarity"),
}


def stage_hashes(params: PipelineParams) -> dict[str, str]:
    """For each stage the sha256 of its own parameters and of the hash before it, so a change redoes all that follows."""
    values, before, out = asdict(params), "", {}
    for stage, names in STAGES.items():
        before = sha256((json.dumps({n: values[n] for n in names}, sort_keys=True) + before).encode()).hexdigest()
        out[stage] = before
    return out
