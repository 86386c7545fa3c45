"""Connected components of a link table by alternating large-star and small-star rounds, with links contracted in tasks first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch

#: Links that a task contracts at once.
HELD = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from every node to the smallest one that these links reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low, before = np.arange(len(nodes)), None
    while before is None or (low != before).any():
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, before[a])
        low = low[low]
    own = low != np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], names=["u", "v"])


def _contracted(batches):
    held: list[pa.RecordBatch] = []

    def stars():
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        held.clear()
        return _stars(u, v)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield stars()
    if held:
        yield stars()


def components(edges: DataFrame, scratch: Scratch, rounds: int | None = None, at_once: bool = False) -> DataFrame:
    """(node, component) for every node of edges (u, v), whole numbers; component is the smallest node that can be reached.

    With rounds no more than so many are made: nodes of one component are still connected, but one that is connected may yet be
    in several. With at_once up to HELD links, which a task contracts in any case, are contracted by one task, and no round is made.

    Each round first turns the links that a task reads into stars of their own components, which shortens long paths. Then
    both star steps rewrite every link with a join and a grouped minimum, and no neighbour list is gathered. A hub's links
    pass one task of that join, as a stream; contraction has left one for each of its neighbours. Rounds end when the links no
    longer change; there they are a star from every node to its component's smallest.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    edges = scratch.cut(edges.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    state, done = None if rounds else _state(edges), 0
    if at_once and state and state[0] <= HELD:
        edges, state = scratch.cut(edges.coalesce(1).mapInArrow(_contracted, "u long, v long"), "stars"), (0, None)
    while state[0] if state else done < rounds:
        stars = edges.mapInArrow(_contracted, "u long, v long")
        both = stars.select("u", "v", F.explode(F.array(F.lit(True), F.lit(False))).alias("turn"))
        both = both.select(F.when(F.col("turn"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("turn"), F.col("v")).otherwise(F.col("u")).alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(edges)
        edges, done = new, done + 1
        if state:
            state, before = _state(new), state
            if state == before:
                break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    return out.groupBy("node").agg(F.min("component").alias("component")) if rounds else out
