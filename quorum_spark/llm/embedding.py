"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length 1, so a cosine of 0.98 is a distance of EPS. Along the leading principal axes of their label's
space they fall into cells of that width; sorted by label and cell (grid order) they are cut into blocks of up to BLOCK
vectors. The sequence of blocks is joined with itself by recursion: intervals of FAN to the power of a level have boxes on all
axes, pairs of intervals of one label whose boxes are provably further apart than EPS are skipped, the others are
replaced by the pairs of their parts. This works on keys and boxes alone. Only the pairs of blocks that are left are read;
there both sequences are halved again and again in the same way, and the smallest ones are compared in double precision.
Every comparison of blocks yields for each vector a number of links, and a link to its part's smallest vector; links
themselves are never emitted.

Equal vectors of a label are one node, so copies cost nothing. The axes are fitted on about SAMPLE vectors, picked by a cut of
hashes and never more than twice as many, and only steer what can be skipped; any axes give the same links. Vectors that are null, zero or hold null or non-finite components link
with nothing, and so do rows whose label or vec_id is null. Vectors of different length don't link. Rows that repeat a vec_id, with equal
or different labels and vectors, are other vectors of that id: the id has the links of all its rows, what any of them leads
to is in its component, and each of its rows gets that answer. Extra columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.graph import components
from quorum_spark.operators.numbering import numbered
from quorum_spark.operators.scratch import Scratch, small_batches

COSINE = 0.98
EPS = float(np.sqrt(2 - 2 * COSINE)) * (1 + 1e-9)
AXES, SAMPLE, BLOCK, LEAF = 8, 10_000, 1024, 128
#: Parts of an interval of the next level.
FAN = 16
NODE = "vec_id long, label int, dim int, set_key binary, unit binary, cells array<int>"
BLOCKS = "label int, dim int, nodes binary, ids binary, sizes binary, units binary, low array<double>, high array<double>"


def _units(vectors: pa.Array):
    """For each length of vectors: the rows that have a direction, their vectors, and these scaled to length 1."""
    lens = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are not numbers here
    begin = np.cumsum(lens) - lens
    for dim in np.unique(lens[lens > 0]).tolist():
        rows = np.flatnonzero(lens == dim)
        v = flat[begin[rows][:, None] + np.arange(dim)]
        top = np.abs(v).max(1)
        ok = np.isfinite(top) & (top > 0)
        rows, v = rows[ok], v[ok]
        u = v / top[ok][:, None]
        yield dim, rows, v, u / np.sqrt((u * u).sum(1))[:, None]


def _nodes(shared):
    def run(batches):
        axes = shared.value
        for batch in batches:
            n = batch.num_rows
            dims, keys, units, cells = np.zeros(n, np.int32), [None] * n, [None] * n, [None] * n
            labelled = np.asarray(batch.column("label").is_valid())
            for dim, rows, v, u in _units(batch.column("embedding")):
                use = labelled[rows]
                rows, v, u = rows[use], np.ascontiguousarray(v[use]), np.ascontiguousarray(u[use])
                dims[rows] = dim
                at = np.floor((u @ axes[dim].T if dim in axes else u[:, :AXES]) / EPS).astype(np.int32)
                for k, r in enumerate(rows.tolist()):
                    keys[r], units[r], cells[r] = blake2b(v[k].data, digest_size=16).digest(), u[k].tobytes(), at[k]
            cols = [pa.array(dims), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(cells, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), *cols], names=["vec_id", "label", "dim", "set_key", "unit", "cells"])

    return run


def _axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal axes for the commonest length of vectors in a sample by a cut of hashes."""
    usable = vectors.where("embedding is not null and label is not null")
    share = min(1.0, SAMPLE / max(1, usable.count()))
    rows = usable.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40))).select("embedding").limit(2 * SAMPLE)
    units = {dim: u for dim, _, _, u in _units(rows.toArrow().column("embedding").combine_chunks()) if len(u)}
    if not units:
        return {}
    dim = max(units, key=lambda d: (len(units[d]), -d))
    x = units[dim]
    return {dim: np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:AXES]}


def _blocks(shared, most: int):
    """Cuts a sorted partition into blocks of one label and length."""

    def run(batches):
        axes, held = shared.value, []

        def block():
            label, dim = held[0][:2]
            x = np.stack([np.frombuffer(r[2], np.float64) for r in held])
            at = x @ axes[dim].T if dim in axes else x[:, :AXES]
            out = [label, dim, *(np.array([r[k] for r in held], np.int64).tobytes() for k in (3, 4, 5)), x.tobytes(), at.min(0).tolist(), at.max(0).tolist()]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], names=["label", "dim", "nodes", "ids", "sizes", "units", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "unit", "node", "rep", "size")), strict=True):
                if held and (held[0][:2] != row[:2] or len(held) == most):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return run


class Side:
    """A block: vectors, their places on the axes, their nodes, smallest ids, and how many copies each stands for."""

    def __init__(self, nodes: bytes, ids: bytes, sizes: bytes, units: bytes, axes: np.ndarray | None):
        self.nodes, self.ids, self.sizes = (np.frombuffer(x, np.int64) for x in (nodes, ids, sizes))
        self.x = np.frombuffer(units, np.float64).reshape(len(self.ids), -1)
        self.at = self.x @ axes.T if axes is not None else self.x[:, :AXES]


def _join(a: Side, b: Side, i: slice, j: slice, links: np.ndarray) -> None:
    """Marks the links between rows i of a and j of b, halving the longer sequence while the boxes are near."""
    gap = np.maximum(0, np.maximum(a.at[i].min(0) - b.at[j].max(0), b.at[j].min(0) - a.at[i].max(0)))
    if gap @ gap > EPS * EPS:
        return
    m, n = i.stop - i.start, j.stop - j.start
    if max(m, n) <= LEAF:
        links[i, j] = a.x[i] @ b.x[j].T >= COSINE
    elif m >= n:
        for part in (slice(i.start, i.start + m // 2), slice(i.start + m // 2, i.stop)):
            _join(a, b, part, j, links)
    else:
        for part in (slice(j.start, j.start + n // 2), slice(j.start + n // 2, j.stop)):
            _join(a, b, i, part, links)


def _roots(a: Side, b: Side, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of both sides the smallest id that they reach by these links."""
    ra, rb, none = a.ids.copy(), b.ids.copy(), np.iinfo(np.int64).max
    while True:
        na = np.minimum(ra, np.where(links, rb, none).min(1))
        nb = np.minimum(rb, np.where(links, na[:, None], none).min(0))
        if (na == ra).all() and (nb == rb).all():
            return ra, rb
        ra, rb = na, nb


def _compare(shared):
    def run(batches):
        axes = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r: batch.column(c)[r].as_py()
                same, own = get("u") == get("v"), axes.get(get("dim"))
                a = Side(get("nodes"), get("ids"), get("sizes"), get("units"), own)
                b = a if same else Side(get("nodes2"), get("ids2"), get("sizes2"), get("units2"), own)
                links = np.zeros((len(a.ids), len(b.ids)), bool)
                _join(a, b, slice(0, len(a.ids)), slice(0, len(b.ids)), links)
                if same:
                    np.fill_diagonal(links, False)
                ra, rb = _roots(a, b, links)
                sides = [(a, links @ b.sizes, ra)] + ([] if same else [(b, a.sizes @ links, rb)])
                for side, n, root in sides:
                    hit = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(side.nodes[hit]), pa.array(side.ids[hit]), pa.array(n[hit].astype(np.int64)), pa.array(root[hit])], names=["node", "rep", "n", "root"])

    return run


def _near(low1: str, high1: str, low2: str, high2: str):
    """Whether two boxes may hold vectors that are EPS apart."""
    gap = lambda i: F.greatest(F.lit(0.0), F.get(low1, i) - F.get(high2, i), F.get(low2, i) - F.get(high1, i))
    return F.aggregate(F.sequence(F.lit(0), F.size(low1) - 1), F.lit(0.0), lambda acc, i: acc + gap(i) * gap(i)) <= EPS * EPS


def _block_pairs(boxes: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v), u before v or the same: blocks that may hold links. boxes: block, label, dim, low, high."""
    boxes = numbered(boxes, ["label", "dim", "block"], "place", scratch)
    boxes = scratch.cut(boxes, "places")
    last, top = boxes.agg(F.max("place")).first()[0] or 0, 0
    while last >= FAN ** (top + 1):
        top += 1
    axis = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(AXES)])

    def level(k: int) -> DataFrame:
        """Intervals of FAN ** k blocks of a label: at, low, high, and the one of the next level that each is in."""
        at, above = (F.floor(F.col("place") / FAN**x) for x in (k, k + 1))
        out = boxes.groupBy("label", "dim", at.alias("at"), above.alias("above")).agg(axis(F.min, "low").alias("low"), axis(F.max, "high").alias("high"))
        keep = lambda c: F.filter(c, lambda x: x.isNotNull()).alias(c)  # noqa: E731  # short vectors have fewer axes
        return out.select("label", "dim", "at", "above", keep("low"), keep("high"))

    pairs = None
    for k in range(top, -1, -1):
        parts = level(k)
        left = parts.select("label", "dim", F.col("at").alias("u"), F.col("above").alias("above_u"), F.col("low").alias("low1"), F.col("high").alias("high1"))
        right = parts.select("label", "dim", F.col("at").alias("v"), F.col("above").alias("above_v"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        both = left.join(right, ["label", "dim"]) if pairs is None else pairs.join(left, ["label", "dim", "above_u"]).join(right, ["label", "dim", "above_v"])
        pairs = both.where("u <= v").where(_near("low1", "high1", "low2", "high2")).select("label", "dim", F.col("u").alias("above_u"), F.col("v").alias("above_v"))
        pairs = scratch.cut(pairs, f"level-{k}")
    names = boxes.select("place", "block")
    pairs = pairs.join(names.select(F.col("place").alias("above_u"), F.col("block").alias("u")), "above_u")
    return pairs.join(names.select(F.col("place").alias("above_v"), F.col("block").alias("v")), "above_v").select("u", "v")


def near_embeddings(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept. block: vectors of a block."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("int").alias("label"))
    axes = spark.sparkContext.broadcast(_axes(vectors))
    nodes = scratch.cut(vectors.mapInArrow(_nodes(axes), NODE), "nodes")
    usable = nodes.where("set_key is not null and vec_id is not null")
    classes = usable.groupBy("label", "set_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.any_value("dim").alias("dim"), F.any_value("unit").alias("unit"), F.any_value("cells").alias("cells"))
    classes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    order = ["label", "dim", *[F.get("cells", F.lit(i)) for i in range(AXES)], "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.select("label", "dim", "unit", "node", "rep", "size", "cells").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = ordered.mapInArrow(_blocks(axes, block), BLOCKS).withColumn("block", F.monotonically_increasing_id())
    blocks = scratch.cut(blocks, "blocks", large_rows=True)
    pairs = _block_pairs(blocks.select("block", "label", "dim", "low", "high"), scratch)
    one = blocks.select(F.col("block").alias("u"), "dim", "nodes", "ids", "sizes", "units")
    two = blocks.select(F.col("block").alias("v"), *[F.col(c).alias(f"{c}2") for c in ("nodes", "ids", "sizes", "units")])
    with small_batches(spark, 4):  # rows are a megabyte here
        found = scratch.cut(pairs.join(one, "u").join(two, "v").mapInArrow(_compare(axes), "node long, rep long, n long, root long"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.select("label", "set_key", "node", "rep", "size").join(counts, "node", "left")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))
    keyed = nodes.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("set_key")).alias("set_key"))
    rows = scratch.cut(keyed.join(known, ["label", "set_key"], "left").select("vec_id", "rep", links.cast("long").alias("n")), "rows")
    ids = rows.groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.min("rep").alias("rep"), F.max("rep").alias("other"))
    ids = scratch.cut(ids, "ids")
    several = rows.join(ids.where("rep <> other").select("vec_id"), "vec_id", "left_semi").where("rep is not null")
    edges = found.select(F.col("rep").alias("u"), F.col("root").alias("v")).union(several.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    comp = components(edges, scratch)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    answers = ids.withColumnRenamed("vec_id", "id").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n_links", component.alias("component_id"))
    out = rows.select("vec_id").join(answers, F.col("vec_id").eqNullSafe(F.col("id")))
    return out.select("vec_id", "n_links", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("vec_id"))).alias("kept"))
