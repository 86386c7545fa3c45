"""Boxes, poses and quality scores, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorum_spark.params import PipelineParams

#: Degrees for a nose that is off by the distance between the eyes.
DEGREES = 65.0


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def pose(x: list[Column], y: list[Column]) -> tuple[Column, Column]:
    """Yaw and pitch from left eye, right eye, nose, left and right mouth corner. 90 each when the eyes coincide."""
    eyes_x, eyes_y = (x[0] + x[1]) / 2, (y[0] + y[1]) / 2
    apart = F.sqrt((x[1] - x[0]) ** 2 + (y[1] - y[0]) ** 2)
    middle = (eyes_y + (y[3] + y[4]) / 2) / 2
    none = apart < 1e-6
    safe = F.when(none, 1.0).otherwise(apart)
    turned = lambda d: F.when(none, 90.0).otherwise(clip(DEGREES * d / safe, -90.0, 90.0))
    return turned(x[2] - eyes_x), turned(y[2] - middle)


def pose_bucket(yaw: Column, split: float) -> Column:
    return F.when(yaw < -split, "left").when(yaw > split, "right").otherwise("frontal")


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of boxes with fields x1, y1, x2, y2; 0 where the union is empty."""
    side = lambda p: F.greatest(F.lit(0.0), F.least(a[f"{p}2"], b[f"{p}2"]) - F.greatest(a[f"{p}1"], b[f"{p}1"]))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    both = side("x") * side("y")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.when(union > 0, union).otherwise(1.0)).otherwise(0.0)


def simple_quality(width: Column, blur: Column, yaw: Column, most: float) -> Column:
    parts = F.least(width / 150, F.lit(1.0)) + F.least(blur / 300, F.lit(1.0)) + F.greatest(F.lit(0.0), 1 - F.abs(yaw) / most)
    return parts / 3


def composite_quality(width: Column, blur: Column, yaw: Column, pitch: Column, p: PipelineParams) -> Column:
    front = lambda d, most: F.greatest(F.lit(0.0), 1 - F.abs(d) / most) if most > 0 else F.lit(0.0)
    frontal = (front(yaw, p.max_abs_yaw_deg) + front(pitch, p.max_abs_pitch_deg)) / 2
    return p.weight_size * F.least(width / 150, F.lit(1.0)) + p.weight_blur * F.least(blur / 300, F.lit(1.0)) + p.weight_frontal * frontal


def reject_reason(valid: Column, score: Column, width: Column, blur: Column, yaw: Column, pitch: Column, bright: Column, p: PipelineParams) -> Column:
    """The first rule that a detection fails, null if none."""
    return (
        F.when(~valid, "invalid_crop")
        .when(score < p.detector_score_min, "low_detector_score")
        .when(width < p.min_face_width_px, "too_small")
        .when(blur < p.min_blur, "too_blurred")
        .when(F.abs(yaw) > p.max_abs_yaw_deg, "yaw_too_extreme")
        .when(F.abs(pitch) > p.max_abs_pitch_deg, "pitch_too_extreme")
        .when((bright < p.min_brightness) | (bright > p.max_brightness), "bad_brightness")
    )


def origins(dim: Column | int, size: int, overlap: int) -> Column:
    """Where tiles begin along one side: steps of size - overlap, the last one flush with the edge."""
    last = F.greatest((dim if isinstance(dim, Column) else F.lit(dim)) - size, F.lit(0))
    return F.array_union(F.sequence(F.lit(0).cast("int"), last.cast("int"), F.lit(size - overlap)), F.array(last.cast("int")))


def shared_frames(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Frames in both ranges, ends included, over the shorter range."""
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0) + 1)
    return both / F.least(a1 - a0 + 1, b1 - b0 + 1)
