"""Detections: overlap suppression and the quality gate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.functions import geometry as G
from quorum_spark.params import PipelineParams


BOX = "array<struct<minus:double,ordinal:bigint,x1:double,y1:double,x2:double,y2:double,score:double>>"


def _kept(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes, from the best score down, overlap none that is kept before them by limit or more."""
    area, keep, gone = (x2 - x1) * (y2 - y1), np.zeros(len(x1), bool), np.zeros(len(x1), bool)
    for i in range(len(x1)):
        if gone[i]:
            continue
        keep[i] = True
        w = np.minimum(x2[i], x2[i + 1 :]) - np.maximum(x1[i], x1[i + 1 :])
        h = np.minimum(y2[i], y2[i + 1 :]) - np.maximum(y1[i], y1[i + 1 :])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        union = area[i] + area[i + 1 :] - both
        gone[i + 1 :] |= np.where(union > 0, both / np.where(union > 0, union, 1), 0) >= limit
    return keep


#: Frames of up to so many boxes are decided side by side, so many boxes at once.
SHORT, HELD = 256, 1 << 17


def _kept_of_frames(at: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, limit: float) -> np.ndarray:
    """_kept of many frames; frame i has boxes at[i] to at[i + 1]. The k-th boxes of all frames of about one length are decided together."""
    keep, lens = np.zeros(len(x1), bool), np.diff(at)
    order = np.argsort(lens, kind="stable")
    begin = int(np.searchsorted(lens[order], 1))
    short = int(np.searchsorted(lens[order], SHORT, "right"))
    for f in order[short:]:
        own = slice(at[f], at[f + 1])
        keep[own] = _kept(x1[own], y1[own], x2[own], y2[own], limit)
    while begin < short:
        size = lens[order[begin:short]]
        n = max(1, int(np.searchsorted(size * np.arange(1, len(size) + 1), HELD, "right")))
        size, frames = size[:n], order[begin : begin + n]
        begin += n
        place = np.arange(size[-1])[:, None]
        own = place < size
        index = np.where(own, at[frames] + place, 0)
        a1, b1, a2, b2 = (c[index] for c in (x1, y1, x2, y2))
        area, gone = (a2 - a1) * (b2 - b1), ~own
        for i in range(len(index) - 1):
            w = np.minimum(a2[i], a2[i + 1 :]) - np.maximum(a1[i], a1[i + 1 :])
            h = np.minimum(b2[i], b2[i + 1 :]) - np.maximum(b1[i], b1[i + 1 :])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            union = area[i] + area[i + 1 :] - both
            gone[i + 1 :] |= (np.where(union > 0, both / np.where(union > 0, union, 1), 0) >= limit) & ~gone[i]
        keep[index[own]] = ~gone[own]
    return keep


def suppress(boxes: DataFrame, key: str, limit: float) -> DataFrame:
    """(key, kept boxes): from the best score down, boxes that overlap a kept one by limit or more go. boxes: key, ordinal, x1..y2, score; equal scores in order of ordinal. A frame's boxes are gathered, since each decision needs the earlier ones."""
    box = F.struct((-F.col("score")).alias("minus"), "ordinal", "x1", "y1", "x2", "y2", "score")
    frames = boxes.groupBy(key).agg(F.array_sort(F.collect_list(box)).alias("kept"))

    def run(batches):
        for batch in batches:
            lists = batch.column("kept")
            offsets, values = lists.offsets.to_numpy(), lists.values
            x1, y1, x2, y2 = (values.field(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
            keep = _kept_of_frames(offsets.astype(np.int64), x1, y1, x2, y2, limit)
            at = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(at), values.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([batch.column(key), kept], names=[key, "kept"])

    return frames.mapInArrow(run, f"`{key}` {boxes.schema[key].dataType.simpleString()}, kept {BOX}")


def overlapping(boxes: DataFrame, key: str, names: list[str], least: float) -> DataFrame:
    """(key, names, names with 2, iou) of pairs of a frame's boxes whose overlap over union, to six places, is above least. boxes: key, names (whole numbers; the first tells a frame's boxes apart and is the smaller one in a pair), x1..y2.

    A frame's boxes are compared as arrays, and only pairs that overlap leave the task.
    """
    fields = [*names, "x1", "y1", "x2", "y2"]
    frames = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in names], "x1", "y1", "x2", "y2"))).alias("b"))

    def run(batches):
        for batch in batches:
            lists = batch.column("b")
            offsets, values = lists.offsets.to_numpy(), {c: lists.values.field(c).to_numpy() for c in fields}
            found = []
            for f, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                x1, y1, x2, y2 = (values[c][a:b] for c in fields[-4:])
                side = lambda lo, hi: np.maximum(np.minimum(hi[:, None], hi) - np.maximum(lo[:, None], lo), 0)
                both, area = side(x1, x2) * side(y1, y2), (x2 - x1) * (y2 - y1)
                union = area[:, None] + area - both
                iou = np.round(np.where(union > 0, both / np.where(union > 0, union, 1), 0), 6)
                p, q = np.nonzero(np.triu(iou > least, 1))
                found.append((np.full(len(p), f), p + a, q + a, iou[p, q]))
            if found:
                row, p, q, iou = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), *[pa.array(values[c][at]) for at in (p, q) for c in names], pa.array(iou)], names=[key, *names, *[f"{c}2" for c in names], "iou"])

    kinds = ", ".join(f"{c}{n} long" for n in ("", "2") for c in names)
    return frames.mapInArrow(run, f"`{key}` {boxes.schema[key].dataType.simpleString()}, {kinds}, iou double")


def gate(detections: DataFrame, p: PipelineParams) -> DataFrame:
    """detections (x1..y2, score, blur, brightness, lx1..ly5) with yaw, pitch, quality_score, reject_reason, accepted. Rejected rows stay."""
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    yaw, pitch = G.pose([F.col(f"lx{i}") for i in range(1, 6)], [F.col(f"ly{i}") for i in range(1, 6)])
    out = detections.withColumns({"yaw": yaw, "pitch": pitch})
    out = out.withColumn("quality_score", G.composite_quality(width, F.col("blur"), F.col("yaw"), F.col("pitch"), p))
    reason = G.reject_reason((width >= 1) & (height >= 1), F.col("score"), width, F.col("blur"), F.col("yaw"), F.col("pitch"), F.col("brightness"), p)
    return out.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())

