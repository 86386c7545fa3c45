"""Checks of an upload's sampled frames before it is processed: faces to frames, frames to uploads, findings to a status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class PreflightParams:
    # The limits that results are compared at.
    sharpness_min: float = 60.0
    backlight_ratio_max: float = 1.8
    min_pan_range: float = 0.25
    max_pan_speed: float = 400.0
    min_face_yield: float = 0.15
    min_coverage: float = 0.6


def frame_samples(frames: DataFrame, faces: DataFrame) -> DataFrame:
    """One row per frame: upload_id, frame, sharpness, faces, x (mean of faces' middles as a share of the width), face_light, upper_light (of frames with faces), moved (pixels since the last frame with faces).

    frames: upload_id, frame, width, sharpness, upper_light; faces: upload_id, frame, x1, x2, light (null where a box is empty).
    """
    per = faces.groupBy("upload_id", "frame").agg(F.count("*").alias("faces"), F.avg((F.col("x1") + F.col("x2")) / 2).alias("middle"), F.avg("light").alias("face_light"))
    rows = frames.join(per, ["upload_id", "frame"], "left").withColumns({"faces": F.coalesce("faces", F.lit(0)), "x": F.col("middle") / F.col("width")})
    before = F.last("x", ignorenulls=True).over(Window.partitionBy("upload_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("upload_id", "frame", "sharpness", "faces", "x", "face_light", F.when(F.col("faces") > 0, F.col("upper_light")).alias("upper_light"), (F.abs(F.col("x") - before) * F.col("width")).alias("moved"))


def upload_samples(uploads: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per upload: upload_id, frames, sharpness (median), face_yield, x_range, pan_speed, light_ratio; null where frames don't tell. uploads: upload_id, expected, seconds. An upload's frames are a small sample."""
    agg = samples.groupBy("upload_id").agg(
        F.count("*").alias("frames"),
        F.percentile("sharpness", F.lit(0.5)).alias("sharpness"),
        F.avg("faces").alias("faces"),
        F.when(F.count("x") >= 2, F.max("x") - F.min("x")).alias("x_range"),
        F.sum("moved").alias("moved"),
        F.avg("face_light").alias("face_light"),
        F.avg("upper_light").alias("upper_light"),
    )
    rows = uploads.join(agg, "upload_id", "left")
    share = lambda a, b, least: F.when(F.col(b) > least, F.col(a) / F.when(F.col(b) > least, F.col(b)))
    return rows.select("upload_id", F.coalesce("frames", F.lit(0)).alias("frames"), "sharpness", share("faces", "expected", 0).alias("face_yield"), "x_range", F.when(F.col("x_range").isNotNull(), share("moved", "seconds", 0)).alias("pan_speed"), share("upper_light", "face_light", 1e-6).alias("light_ratio"))


def preflight(measured: DataFrame, p: PreflightParams = PreflightParams()) -> DataFrame:
    """measured (of upload_samples) with checks, an array of check and severity in a fixed order, and status: fail if any fails, else warn if any warns, else pass. An upload without frames fails as unreadable and has no other check."""
    some = F.col("frames") > 0
    wide = F.coalesce(F.col("x_range") < p.min_pan_range, F.lit(False))
    found = (
        (~some, "unreadable_video", "fail"),
        (some & (F.col("sharpness") < p.sharpness_min), "blurry_video", "fail"),
        (some & (F.col("face_yield") < p.min_face_yield), "low_face_yield", "fail"),
        (some & wide, "no_pan_detected", "fail"),
        (some & ~wide & (F.col("x_range") < p.min_coverage), "partial_coverage", "warn"),
        (some & (F.col("pan_speed") > p.max_pan_speed), "pan_too_fast", "fail"),
        (some & (F.col("light_ratio") > p.backlight_ratio_max), "backlit", "fail"),
    )
    checks = F.filter(F.array(*[F.when(bad, F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"))) for bad, name, severity in found]), lambda c: c.isNotNull())
    rows = measured.withColumn("checks", checks)
    any_of = lambda s: F.exists("checks", lambda c: c.severity == s)
    return rows.withColumn("status", F.when(any_of("fail"), "fail").when(any_of("warn"), "warn").otherwise("pass"))
