"""The similarity transform that brings a face's five landmarks onto reference points, by least median of squares.

Five landmarks have ten pairs, so all of them are tried: the two-point transform whose third smallest squared error is the least, of
equal ones the first pair's. Landmarks within its inlier distance then give the least-squares transform.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The reference points of a crop of 112 pixels, (x, y) of eyes, nose tip and mouth corners.
REFERENCE = [(38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041)]
SIZE = 112
PAIRS = list(combinations(range(5), 2))
#: Inliers are within this many times the root of the least median, and at least LEAST pixels.
SPREAD, LEAST = 2.5 * 1.4826 * (1 + 5 / 3), 0.001
OUT = ("re", "im", "tx", "ty", "median", "inliers")


def transforms(x: np.ndarray, y: np.ndarray, size: int = SIZE) -> np.ndarray:
    """re, im, tx, ty, median and number of inliers of each row of five landmarks; not a number where no two of them differ or one isn't finite."""
    z, w = x + 1j * y, np.array([complex(*p) for p in REFERENCE]) * (size / SIZE)
    i, j = np.array(PAIRS).T
    with np.errstate(all="ignore"):
        a = (w[j] - w[i]) / (z[:, j] - z[:, i])
        t = w[i] - a * z[:, i]
        errors = np.abs(a[:, :, None] * z[:, None] + t[:, :, None] - w) ** 2
        medians = np.sort(errors, 2)[:, :, 2]
        medians = np.where(np.isfinite(medians), np.round(medians, 9), np.inf)
        rows, best = np.arange(len(z)), medians.argmin(1)
        least = medians[rows, best]
        near = errors[rows, best] <= np.maximum(SPREAD * np.sqrt(least), LEAST)[:, None] ** 2
        n = near.sum(1)
        mean = lambda v: np.where(near, v, 0).sum(1) / n
        zc, wc = z - mean(z)[:, None], w - mean(np.broadcast_to(w, z.shape))[:, None]
        size2 = np.where(near, np.abs(zc) ** 2, 0).sum(1)
        fitted = np.where(near, zc.conj() * wc, 0).sum(1) / size2
        own = size2 > 0
        a = np.where(own, fitted, a[rows, best])
        t = np.where(own, mean(np.broadcast_to(w, z.shape)) - fitted * mean(z), t[rows, best])
    out = np.stack([a.real, a.imag, t.real, t.imag, least, n.astype(float)], 1)
    out[~np.isfinite(least)] = np.nan
    return out


def aligned(detections: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """(keys, re, im, tx, ty, median, inliers): x' = re x - im y + tx, y' = im x + re y + ty. detections: lx1, ly1 to lx5, ly5. Faces without a transform, and those with a null landmark, have nulls."""
    marks = [f"l{c}{k}" for c in "xy" for k in range(1, 6)]

    def run(batches):
        for batch in batches:
            get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x, y = (np.stack([get(c) for c in marks[5 * k : 5 * k + 5]], 1) for k in (0, 1))
            found = transforms(x, y, size)
            columns = [pa.array(found[:, k], from_pandas=True) for k in range(len(OUT))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in keys], *columns], names=[*keys, *OUT])

    kinds = "".join(f"`{k}` {detections.schema[k].dataType.simpleString()}, " for k in keys)
    return detections.select(*keys, *marks).mapInArrow(run, kinds + ", ".join(f"{c} double" for c in OUT))
