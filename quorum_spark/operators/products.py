"""Matrix products of two tables of vectors block by block, and what is made of them in place: best matches, histograms, exact quantiles.

Both tables are dealt to packs of BLOCK vectors by a hash. Every pack of one meets every pack of the other by explicit keys, a pair
of packs is one product in a task, and only what its kernel yields leaves the task, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.metric import array_of, packs
from quorum_spark.operators.scratch import Scratch, small_batches

#: Vectors of a pack.
BLOCK = 1024
#: Bits of a value that a pass of quantiles settles.
DIGIT = 16

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def products(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """What kernel(i, j, s) yields for each pair of packs: ids of left (id, v), ids of right, and their products. Ids of right ascend."""
    size = right.agg(F.floor(F.count("*") / BLOCK).alias("more"))
    a = packs(left, "id", "v", [], BLOCK).select(F.col("ids").alias("i"), F.col("v").alias("x"))
    b = packs(right, "id", "v", [], BLOCK).select("b", F.col("ids").alias("j"), F.col("v").alias("y"))
    met = a.crossJoin(F.broadcast(size)).select("i", "x", F.explode(F.sequence(F.lit(0).cast("long"), "more")).alias("b")).join(b, "b")  # size is one row

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, x, j, y = (array_of(batch, c, r) for c in ("i", "x", "j", "y"))
                order = np.argsort(j, kind="stable")
                yield from kernel(i, j[order], x.reshape(len(i), -1) @ y.reshape(len(j), -1)[order].T)

    with small_batches(left.sparkSession, 16):  # a row has two packs of vectors
        return Scratch(left.sparkSession, "products").cut(met.select("i", "x", "j", "y").mapInArrow(run, schema), "found")


def all_products(left: DataFrame, right: DataFrame, kind: str = "long") -> DataFrame:
    """(i, j, s) for all pairs, where the pairs are what is asked for."""

    def kernel(i, j, s):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(s.ravel())], names=["i", "j", "s"])

    return products(left, right, kernel, f"i {kind}, j {kind}, s double")


def product_histogram(left: DataFrame, right: DataFrame, low: float, high: float, bins: int, digits: int) -> DataFrame:
    """(bin, n) of all products, rounded to digits, over equal bins, the last one closed; those outside are left out."""

    def kernel(i, j, s):
        s = np.round(s.ravel(), digits)
        b = np.minimum(np.floor((s[(s >= low) & (s <= high)] - low) / ((high - low) / bins)), bins - 1).astype(np.int64)
        n = np.bincount(b, minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0].astype(np.int64))], names=["bin", "n"])

    return products(left, right, kernel, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def _ordered(s: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = (s + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) > 0, ~bits, bits | np.uint64(1 << 63))


def _value(u: int) -> float:
    bits = u ^ (1 << 63) if u >> 63 else u ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digits(prefixes: list[int], shift: int):
    """For each prefix how many products have each next digit, and their sum."""

    def kernel(i, j, s):
        s = s.ravel()
        u = _ordered(s)
        for p in prefixes:
            use = u >> np.uint64(shift) >> np.uint64(DIGIT) == p if shift + DIGIT < 64 else np.ones(len(u), bool)
            digit = (u[use] >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
            n = np.bincount(digit)
            hit = np.flatnonzero(n)
            sums = np.bincount(digit, weights=s[use]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(hit), pa.int64()), pa.array(hit), pa.array(n[hit].astype(np.int64)), pa.array(sums[hit])], names=["prefix", "digit", "n", "s"])

    return kernel


def product_quantiles(left: DataFrame, right: DataFrame, shares: list[float]) -> tuple[float | None, list[float | None]]:
    """The mean of all products and their exact quantiles by linear interpolation.

    A histogram of the values' leading bits tells which of them each rank asked for falls into, and the next pass looks at the
    next bits of those alone, until all bits are known. The driver sees the histograms, whose size the data don't change.
    """
    total, mean, targets = None, None, []
    for shift in range(64 - DIGIT, -1, -DIGIT):
        prefixes = sorted({p for _, p in targets}) or [0]
        rows = products(left, right, _digits(prefixes, shift), "prefix long, digit long, n long, s double").groupBy("prefix", "digit").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        by: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["prefix"], r["digit"])):
            by.setdefault(int(r["prefix"]), []).append((r["digit"], r["n"]))
        if total is None:
            total = sum(r["n"] for r in rows)
            if not total:
                return None, [None] * len(shares)
            mean = math.fsum(r["s"] for r in rows) / total
            places = [p * (total - 1) for p in shares]
            targets = [(k, 0) for place in places for k in (math.floor(place), math.ceil(place))]
        nearer = []
        for rank, prefix in targets:
            for digit, n in by[prefix]:
                if rank < n:
                    nearer.append((rank, prefix << DIGIT | digit))
                    break
                rank -= n
        targets = nearer
    values = [_value(u) for _, u in targets]
    return mean, [low + (high - low) * (place - math.floor(place)) for low, high, place in zip(values[::2], values[1::2], places, strict=True)]
