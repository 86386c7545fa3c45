"""From uploads and detections to enrolment: validation, clipping, tiles, single faces, largest faces, summaries."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum_spark.functions import geometry as G
from quorum_spark.operators.detections import suppress
from quorum_spark.operators.ledger import top_rows
from quorum_spark.params import PipelineParams

#: Kinds of video files, limits of their length in seconds and of their shorter side.
EXTENSIONS = ("mp4", "mov", "m4v", "webm")
SHORTEST, LONGEST, SHORTER_SIDE = 20, 300, 1080
POSES = ("left", "frontal", "right")


def first_failing(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule whose condition holds, null if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, code in rules:
        out = out.when(condition, code)
    return out


def allowed_extension(name: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).isin(*EXTENSIONS), F.lit(False))


def video_error(seconds: Column, width: Column, height: Column) -> Column:
    return first_failing((seconds < SHORTEST, "video_too_short"), (seconds > LONGEST, "video_too_long"), (F.least(width, height) < SHORTER_SIDE, "resolution_too_low"))


def assembled(chunks: DataFrame) -> DataFrame:
    """(upload_id, n_chunks, chunks in order): of chunks sent again the last counts. chunks: upload_id, chunk, sent (order of arrival), part."""
    last = chunks.groupBy("upload_id", "chunk").agg(F.max_by("part", "sent").alias("part"))
    whole = last.groupBy("upload_id").agg(F.count("*").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("c"))
    return whole.select("upload_id", "n_chunks", F.transform("c", lambda x: x.part).alias("parts"))


def concatenated(chunks: DataFrame, upload: str = "upload_id") -> DataFrame:
    """(upload_id, n_chunks, n_bytes, sha256) of each upload's chunks in order; of chunks sent again the last counts. chunks: upload_id, chunk, sent, data (binary).

    Chunks are sorted within the tasks of their uploads and pass as a stream: of an upload no more is held than a batch of chunks.
    """
    last = chunks.groupBy(upload, "chunk").agg(F.max_by("data", "sent").alias("data"))
    ordered = last.repartition(upload).sortWithinPartitions(upload, "chunk")
    return ordered.select(upload, "data").mapInArrow(_streamed(upload), f"{upload} {chunks.schema[upload].dataType.simpleString()}, n_chunks long, n_bytes long, sha256 string")


def _streamed(upload: str):
    def run(batches):
        whole, now, n, size = None, None, 0, 0
        for batch in batches:
            kind, done = batch.schema.field(upload).type, []
            for key, data in zip(batch.column(upload).to_pylist(), batch.column("data"), strict=True):
                if whole is None or key != now:
                    if whole is not None:
                        done.append((now, n, size, whole.hexdigest()))
                    whole, now, n, size = sha256(), key, 0, 0
                if data.is_valid:
                    whole.update(data.as_buffer())
                    size += data.as_buffer().size
                n += 1
            yield _row_batch(done, upload, kind)
        if whole is not None:
            yield _row_batch([(now, n, size, whole.hexdigest())], upload, kind)

    return run


def _row_batch(rows: list[tuple], upload: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (kind, pa.int64(), pa.int64(), pa.string()), strict=True)], names=[upload, "n_chunks", "n_bytes", "sha256"])


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new, which replace those of the same key. Of new rows of one key the one with the largest ordinal counts; old: without ordinal."""
    rows = old.withColumn("ordinal", F.lit(-1).cast("long")).unionByName(new)
    return top_rows(rows, key, [F.desc("ordinal")]).drop("rank", "ordinal")


def clipped(detections: DataFrame, width: int, height: int) -> DataFrame:
    """detections with x1..y2 as whole pixels inside the frame and valid. Boxes that are empty then have blur and brightness 0, score 0, and 90 degrees of yaw and pitch."""
    side = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), F.lit(most)))
    out = detections.withColumns({"x1": side("x1", width), "y1": side("y1", height), "x2": side("x2", width), "y2": side("y2", height)})
    out = out.withColumn("valid", (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    fixed = {"blur": 0.0, "brightness": 0.0, "score": 0.0, "yaw": 90.0, "pitch": 90.0}
    return out.withColumns({c: F.when(F.col("valid"), F.col(c)).otherwise(v) for c, v in fixed.items() if c in detections.columns})


def in_frame(tiles: DataFrame, whole: DataFrame, scale: float) -> DataFrame:
    """Detections of tiles, moved by tile_x and tile_y, and of the shrunken whole frame, enlarged by 1 / scale; ordinals of the latter come last."""
    moved = tiles.select("frame_index", "ordinal", *[(F.col(c) + F.col(f"tile_{c[0]}")).alias(c) for c in ("x1", "y1", "x2", "y2")], "score", F.lit(False).alias("from_whole"))
    grown = whole.select("frame_index", "ordinal", *[(F.col(c) / scale).alias(c) for c in ("x1", "y1", "x2", "y2")], "score", F.lit(True).alias("from_whole"))
    return moved.unionByName(grown).withColumn("ordinal", F.when(F.col("from_whole"), F.col("ordinal") + (1 << 40)).otherwise(F.col("ordinal"))).drop("from_whole")


def tiled(tiles: DataFrame, whole: DataFrame, scale: float, p: PipelineParams) -> DataFrame:
    """(frame_index, k, x1..y2, score): detections of tiles and of the whole frame together, suppressed, then those with a score that is high enough."""
    kept = suppress(in_frame(tiles, whole, scale), "frame_index", p.nms_iou).select("frame_index", F.posexplode("kept").alias("k", "b"))
    return kept.select("frame_index", "k", "b.x1", "b.y1", "b.x2", "b.y2", "b.score").where(F.col("score") >= p.detector_score_min)


def largest_face(detections: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Each key's detection with the largest area, of equal ones the first by ordinal."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return top_rows(detections.withColumn("area", area), key, [F.desc("area"), F.col(ordinal)]).drop("rank")


def enrolment_crops(detections: DataFrame, key: str, p: PipelineParams) -> DataFrame:
    """Detections of frames with a single face (key: the frame) that pass every gate, with simple_quality and pose bucket. detections: with yaw and pitch."""
    alone = detections.groupBy(key).agg(F.count("*").alias("faces")).where("faces = 1").select(key)
    w = F.col("x2") - F.col("x1")
    ok = (w >= p.min_face_width_px) & (F.abs("yaw") <= p.max_abs_yaw_deg) & (F.abs("pitch") <= p.max_abs_pitch_deg) & (F.col("blur") >= p.min_blur) & F.col("brightness").between(p.min_brightness, p.max_brightness)
    quality = G.simple_quality(w, F.col("blur"), F.col("yaw"), p.max_abs_yaw_deg)
    return detections.join(alone, key, "left_semi").where(ok).withColumns({"quality": quality, "bucket": G.pose_bucket(F.col("yaw"), p.pose_split_deg)})


def enrolment_summary(crops: DataFrame, key: str, p: PipelineParams) -> DataFrame:
    """(key, left, frontal, right, total, warnings): a warning for too few crops, and one for each pose without any. crops: key, bucket."""
    n = crops.groupBy(key).agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in POSES], F.count("*").alias("total"))
    few = F.when(F.col("total") < p.min_photos, F.concat(F.lit("only "), F.col("total").cast("string"), F.lit(" usable crops")))
    none = [F.when(F.col(b) == 0, F.lit(f"no {b} crops")) for b in POSES]
    return n.withColumn("warnings", F.filter(F.array(few, *none), lambda w: w.isNotNull()))


def preflight(samples: DataFrame, key: str, p: dict[str, float]) -> DataFrame:
    """(key, n, sharp, n_checks, status): checks of a group's samples, fail if any fails, else warn if any warns, else pass. samples: key, value. p: least_detections, least_sharpness, least_spread."""
    groups = samples.groupBy(key).agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("sharp"), (F.max("value") - F.min("value")).alias("spread"))
    check = lambda bad, name, state: F.when(bad, F.struct(F.lit(name).alias("check"), F.lit(state).alias("state")))
    checks = F.array(
        check(F.col("n") < p["least_detections"], "few_detections", "fail"),
        check(F.col("sharp") < p["least_sharpness"], "soft", "warn"),
        check(F.col("spread") < p["least_spread"], "narrow", "warn"),
    )
    found = groups.withColumn("checks", F.filter(checks, lambda c: c.isNotNull()))
    any_of = lambda s: F.exists("checks", lambda c: c.state == s)
    return found.select(key, "n", "sharp", F.size("checks").alias("n_checks"), F.when(any_of("fail"), "fail").when(any_of("warn"), "warn").otherwise("pass").alias("status"))
