"""Bounded training samples, fits in a task, and small parts that the classifiers share."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum_spark.llm.words import give_back

if TYPE_CHECKING:  # pandas is loaded where models are fitted, in tasks
    import pandas as pd

_CUTS = 1 << 40


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo a number."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


#: Values of a target that a model learns at most, the commonest ones.
MOST_VALUES = 256


def counts_of(rows: DataFrame, target: str, most: int = MOST_VALUES) -> dict:
    """How many rows have each of the commonest values of target, of equal counts the smallest values. A dirty column with very many values costs the driver and the model no more than that."""
    counts = rows.where(F.col(target).isNotNull()).groupBy(target).count().orderBy(F.desc("count"), target).limit(most)
    return {r[0]: r[1] for r in sorted(counts.collect(), key=lambda r: r[0])}


def sample(rows: DataFrame, docs: DataFrame, target: str, counts: dict, most: dict) -> DataFrame:
    """About most[v] of the rows (doc_id, target) for each value v, the same whatever the partitioning, with their documents' columns.

    Ids are picked by their hash before any text is read, so no rows are gathered to choose among them, and a broadcast of the
    ids meets the texts. Of documents that repeat an id one counts. counts: how many rows each value has.
    """
    share = F.lit(0)
    for v, n in counts.items():
        share = F.when(F.col(target) == v, int(_CUTS * min(1, most.get(v, 0) / max(n, 1)))).otherwise(share)
    ids = rows.select("doc_id", target).where(F.pmod(F.xxhash64("doc_id"), F.lit(_CUTS)) < share).distinct()
    own = docs.join(F.broadcast(ids), "doc_id")
    rest = [c for c in docs.columns if c not in ("doc_id", target)]
    one = own.groupBy("doc_id", target).agg(F.min(F.struct(F.xxhash64("text").alias("_order"), *rest)).alias("d"))
    return one.select("doc_id", target, *[F.col(f"d.{c}").alias(c) for c in rest])


def fitted(rows: DataFrame, train: Callable[[pd.DataFrame], object], *order: str):
    """What train makes of bounded rows, None if there are none. One task holds them, so neither texts nor the fit weigh on the driver."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).to_pandas().sort_values(list(order), kind="stable").reset_index(drop=True)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table))], pa.binary())], names=["model"])
            del table
            give_back()

    out = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(out[0]["model"]) if out else None


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of rows at[i] to at[i + 1]."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]
