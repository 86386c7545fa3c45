"""Density clustering of crops by cosine distance, cluster diagnostics, and merging and splitting by time.

Crops: det_id, frame_index, quality_score, v (array of doubles, length 1). Labels: det_id, cluster_id, -1 for noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum_spark.functions.geometry import shared_frames
from quorum_spark.functions.vectors import dot, normalize
from quorum_spark.operators import metric
from quorum_spark.operators.graph import HELD, components, contracted
from quorum_spark.operators.numbering import numbered
from quorum_spark.operators.scratch import Scratch


def eps_pairs(crops: DataFrame, eps: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, distance) with i < j and a cosine distance up to eps. by: columns, of whole numbers or text, within which crops are compared, such as the job.

    Crops meet by sides of a few thousand, and of these only blocks whose balls are near enough are compared (see metric).
    """
    blocks = metric.balls(crops, Scratch(crops.sparkSession, "eps"), by)

    def kernel(a, b, same):
        for rows, cols, hit, d in metric.hits(a, b, eps):
            if same:
                hit &= a.ids[rows][:, None] < b.ids[cols]
            p, q = np.nonzero(hit)
            i, j = a.ids[rows][p], b.ids[cols][q]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(d[p, q])], names=["i", "j", "distance"])

    return metric.squares(blocks, kernel, "i long, j long, distance double", by)


def _reached(hit: np.ndarray) -> np.ndarray:
    """Of nodes in ascending order and what each is near, the first node that each one leads to. Every row is read once."""
    root = np.full(len(hit), -1)
    for k in range(len(hit)):
        if root[k] < 0:
            root[k], front = k, np.array([k])
            while len(front):
                front = np.flatnonzero(hit[front].any(0) & (root < 0))
                root[front] = k
    return root


NONE = np.iinfo(np.int64).max


def _tile(eps: float, min_samples: int):
    """The tile's blocks with, for each crop, whether its neighbours in the tile make it core and the smallest core that such cores of the tile lead to, or of a crop that isn't core the smallest one of its neighbours, which is final if there is no other tile; NONE if there is none. Vectors that no other tile needs aren't repeated."""

    def kernel(x, tile, alone):
        order = np.argsort(x.ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        near = np.zeros((len(order), len(order)), bool)
        for rows, cols, hit, _ in metric.hits(x, x, eps):
            near[np.ix_(place[rows], place[cols])] = hit
        ids, n = x.ids[order], near.sum(1)
        core = n + 1 >= min_samples
        root = np.full(len(ids), NONE)
        at = np.flatnonzero(core)
        root[at] = ids[at][_reached(near[np.ix_(at, at)])]
        for k in np.flatnonzero(~core & (n > 0)) if alone else ():
            root[k] = root[near[k] & core].min(initial=NONE)
        parts = lambda c, kind: pa.array([c[i:j] for i, j in zip(x.at, x.at[1:])], pa.list_(kind))
        vectors = pa.nulls(len(x.radius), pa.list_(pa.float64())) if alone else pa.array([x.v[i:j].ravel() for i, j in zip(x.at, x.at[1:])], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.name), pa.array(np.full(len(x.name), tile)), pa.array(np.full(len(x.name), alone)), parts(x.ids, pa.int64()), vectors, pa.array(list(x.centre), pa.list_(pa.float64())), pa.array(x.radius), parts(root[place], pa.int64()), parts(core[place], pa.bool_())],
            names=["block", "tile", "final", "ids", "v", "centre", "radius", "root", "core"],
        )

    return kernel


def _met(hit: np.ndarray, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different marks of rows and columns that hits tie, each pair once. Where hits are many, as among near copies, they aren't listed."""
    (us, a), (vs, b) = (np.unique(m, return_inverse=True) for m in (mine, other))
    if np.count_nonzero(hit) * 16 > hit.size:
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        hit = np.logical_or.reduceat(hit[i], np.searchsorted(a[i], np.arange(len(us))), axis=0)
        hit = np.logical_or.reduceat(hit[:, j], np.searchsorted(b[j], np.arange(len(vs))), axis=1)
        p, q = np.nonzero(hit)
    else:
        p, q = np.nonzero(hit)
        code = np.unique(a[p] * len(vs) + b[q])
        p, q = np.divmod(code, max(len(vs), 1))
    use = us[p] != vs[q]
    return us[p][use], vs[q][use]


class _Links:
    """Links between marks, contracted into stars as they are found."""

    def __init__(self):
        self.u, self.v, self.held = [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.u.append(u)
            self.v.append(v)
            self.held += len(u)
        if self.held > HELD:
            u, v = self.stars()
            self.u, self.v, self.held = [u], [v], 0

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.int64)]
        return contracted(np.concatenate(self.u or none), np.concatenate(self.v or none))


#: What a row of the first look tells: a link u, v between roots; n neighbours of an open crop u; a neighbour v of an open crop u that has few.
LINK, COUNT, BESIDE = 0, 1, 2


def _looked(eps: float, min_samples: int):
    """All that a's crops tell of b's: links of a's cores, how many neighbours each other crop of a has, and which, where they are too few to make it core."""

    def kernel(a, b):
        n, links = np.zeros(len(a.ids), np.int64), _Links()
        at, near = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows, cols, hit, _ in metric.hits(a, b, eps):
            own = a.core[rows]
            if own.any():
                use = b.core[cols]
                links.add(*_met(hit[own][:, use], a.root[rows][own], b.root[cols][use]))
            rest = rows.start + np.flatnonzero(~own)
            if len(rest):
                hit = hit[~own]
                count = hit.sum(1)
                n[rest] += count
                few = (count > 0) & (count + 1 < min_samples)
                p, q = np.nonzero(hit[few])
                at.append(rest[few][p])
                near.append(b.ids[cols][q])
        at, near, some = np.concatenate(at), np.concatenate(near), n > 0
        few = n[at] + 1 < min_samples
        u, v = links.stars()
        for kind, x, y, z in ((LINK, u, v, 0), (COUNT, a.ids[some], 0, n[some]), (BESIDE, a.ids[at[few]], near[few], 0)):
            full = lambda c: pa.array(np.broadcast_to(np.asarray(c, np.int64), len(x)).copy())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([full(kind), full(x), full(y), full(z)], names=["kind", "u", "v", "n"])

    return kernel


def _linked(eps: float):
    """Links between the marks of a's crops and the roots of b's cores that they are near, contracted into stars."""

    def kernel(a, b):
        links = _Links()
        for rows, cols, hit, _ in metric.hits(a, b, eps):
            use = b.core[cols]
            links.add(*_met(hit[:, use], a.mark[rows], b.root[cols][use]))
        u, v = links.stars()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return kernel


def _crops(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, final, det_id, root, core): what tiles tell of each crop, without vectors."""
    each = tiles.select(*keys, "block", "final", F.explode(F.arrays_zip("ids", "root", "core")).alias("c"))
    return each.select(*keys, "block", "final", F.col("c.ids").alias("det_id"), F.col("c.root").alias("root"), F.col("c.core").alias("core"))


def _across(tiles: DataFrame, eps: float, min_samples: int, scratch: Scratch, by: tuple[str, ...]) -> DataFrame:
    """(by, det_id, root, core) of crops whose keys have several tiles, from what their tiles tell.

    The vectors meet twice: first crops that aren't core in their tile, and one tile's cores, meet all; then cores outside the largest cluster do.
    """
    keys = list(by)
    crops = _crops(tiles, keys)
    every = tiles.select(*keys, "block", "ids", "v", "centre", "radius", "root", "core")
    # One tile's cores tie most of the others together. Few neighbours are listed, so no crop has to be compared again for its border.
    first = metric.picked(tiles, lambda core, tile: ~core if tile else np.ones(len(core), bool), scratch, by)
    told = scratch.cut(metric.rectangles(first, every, _looked(eps, min_samples), "kind long, u long, v long, n long", by), "told")
    n = told.where(F.col("kind") == COUNT).groupBy(F.col("u").alias("det_id")).agg(F.sum("n").alias("n"))
    more = scratch.cut(crops.where("not core").select(*keys, "block", "det_id").join(n.where(F.col("n") + 1 >= min_samples), "det_id").select(*keys, "block", "det_id", F.col("det_id").alias("root")), "more")
    links = told.where(F.col("kind") == LINK).select("u", "v")
    ends = components(links, scratch, at_once=True).withColumnRenamed("node", "root")
    sizes = crops.where("core").groupBy(*keys, "root").agg(F.count("*").alias("n"))
    sizes = scratch.cut(sizes.join(ends, "root", "left").withColumn("component", F.coalesce("component", "root")), "sizes")
    large = sizes.groupBy(*keys, "component").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.max_by("component", F.struct("n", "component")).alias("component"))
    outside = sizes.join(large, [*keys, "component"], "left_anti").select("root")
    # A link that is still missing has an end outside the largest component.
    mark = F.col("root").alias("mark")
    chosen = scratch.cut(crops.where("core").join(outside, "root", "left_semi").select("block", "det_id", mark).union(more.select("block", "det_id", mark)), "chosen")
    if not chosen.isEmpty():
        added = metric.part(tiles, more.select("block", "det_id", mark), scratch, by).withColumnRenamed("mark", "root").withColumn("core", F.transform("root", lambda _: F.lit(True)))
        found = metric.rectangles(metric.part(tiles, chosen, scratch, by), every.unionByName(added), _linked(eps), "u long, v long", by)
        ends = components(links.union(scratch.cut(found, "links").select("u", "v")), scratch, at_once=True).withColumnRenamed("node", "root")
    cores = crops.where("core").select(*keys, "det_id", "root").union(more.select(*keys, "det_id", "root"))
    cores = scratch.cut(cores.join(ends, "root", "left").select(*keys, "det_id", F.coalesce("component", "root").alias("root")), "cores")
    beside = told.where(F.col("kind") == BESIDE).select(F.col("u").alias("at"), F.col("v").alias("det_id")).join(more.select(F.col("det_id").alias("at")), "at", "left_anti")
    border = beside.join(cores, "det_id").groupBy(*keys, F.col("at").alias("det_id")).agg(F.min("root").alias("root"))
    return scratch.cut(cores.select(*keys, "det_id", "root", F.lit(True).alias("core")).union(border.select(*keys, "det_id", "root", F.lit(False))), "across")


def dbscan(crops: DataFrame, eps: float, min_samples: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, det_id, cluster_id, core). A crop with min_samples neighbours, itself included, is core; linked cores are a cluster, numbered by their smallest det_id; other neighbours of cores join the lowest number.

    by: columns, such as the job, each of whose values is clustered and numbered by itself; det_id is unique all the same.
    Tiles of a few thousand crops are clustered by themselves. Crops that are core in their tile are so for good, so only the others are
    compared with all, together with the cores of one tile, which tie the tiles' clusters; then only cores outside the largest cluster are
    compared with all cores. No pair whose outcome is open is left out. Pairs are listed for crops that aren't core alone, which have fewer than min_samples.
    """
    spark, keys = crops.sparkSession, list(by)
    scratch = Scratch(spark, "dbscan")
    blocks = metric.balls(crops, scratch, by)
    kinds = "block long, tile long, final boolean, ids array<long>, v array<double>, centre array<double>, radius double, root array<long>, core array<boolean>"
    with metric.small_batches(spark, 16):
        tiles = scratch.cut(metric.in_tiles(blocks, _tile(eps, min_samples), kinds, by), "tiles", large_rows=True)
    scratch.drop(blocks)
    told = _crops(tiles, keys).where(F.col("final") & (F.col("root") < NONE)).select(*keys, "det_id", "root", "core")
    rest = tiles.where("not final")
    if not rest.select("block").isEmpty():
        told = told.union(_across(rest, eps, min_samples, scratch, by))
    roots = told.where("core").select(*keys, "root").distinct()
    if keys:
        number = roots.select(*keys, "root", (F.row_number().over(Window.partitionBy(*keys).orderBy("root")) - 1).alias("cluster_id"))
    else:
        number = numbered(roots, ["root"], "cluster_id", scratch).select("root", "cluster_id")
    label = told.join(number, [*keys, "root"]).select("det_id", "core", F.col("cluster_id").cast("int").alias("cluster_id"))
    out = crops.select(*keys, "det_id").join(label, "det_id", "left")
    return out.select(*keys, "det_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), F.coalesce("core", F.lit(False)).alias("core"))


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def mean_vectors(rows: DataFrame, key: str | list[str], weight: str | None = None) -> DataFrame:
    """(key, mean): the mean of v, weighted by at least 1e-6, scaled to length 1. Sums are taken per component, so groups of any size are pre-aggregated."""
    keys = _keys(key)
    w = F.greatest(F.col(weight), F.lit(1e-6)) if weight else F.lit(1.0)
    flat = rows.select(*keys, w.alias("w"), F.posexplode("v").alias("k", "x"))
    sums = flat.groupBy(*keys, "k").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m"))
    return whole.select(*keys, normalize(F.transform("m", lambda s: s.x)).alias("mean"))


def _tightness() -> Column:
    """From the sums' squares s, the squares' sum q and the members m."""
    return F.when(F.col("m") <= 1, 1.0).otherwise((F.col("s") - F.col("q")) / (F.col("m") * F.greatest(F.col("m") - 1, F.lit(1))))


def tightness(rows: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, tightness): the mean cosine of a group's pairs, by its sums alone; 1 for a single member."""
    keys = _keys(key)
    flat = rows.select(*keys, F.posexplode("v").alias("k", "x")).groupBy(*keys, "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("m"))
    total = flat.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"), F.max("m").alias("m"))
    return total.select(*keys, _tightness().alias("tightness"))


def summarize(crops: DataFrame, labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per cluster, of each job if by names its columns: member_count, mean_quality, first_frame, last_frame, best_det, tightness, representative."""
    keys = [*by, "cluster_id"]
    rows = crops.join(labels.where("cluster_id >= 0").select("det_id", "cluster_id"), "det_id")
    basic = rows.groupBy(*keys).agg(
        F.count("*").alias("member_count"),
        F.avg("quality_score").alias("mean_quality"),
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        F.max_by("det_id", F.struct("quality_score", -F.col("det_id"))).alias("best_det"),
    )
    # Vectors are sent once for both their mean (as in mean_vectors) and their tightness.
    w, x = F.greatest("quality_score", F.lit(1e-6)), F.col("x")
    flat = rows.select(*keys, w.alias("w"), F.posexplode("v").alias("k", "x")).groupBy(*keys, "k").agg((F.sum(x * F.col("w")) / F.sum("w")).alias("x"), F.sum("x").alias("s"), F.sum(x * x).alias("q"), F.count("*").alias("m"))
    total = flat.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"), F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("mean"))
    vectors = total.select(*keys, _tightness().alias("tightness"), normalize(F.transform("mean", lambda c: c.x)).alias("representative"))
    return basic.join(vectors, keys)


def distances(crops: DataFrame, labels: DataFrame, summary: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each crop's distance to its cluster's representative, null for noise."""
    keys = [*by, "cluster_id"]
    rows = crops.join(labels.select("det_id", "cluster_id"), "det_id").join(summary.select(*keys, "representative"), keys, "left")
    return rows.select(*by, "det_id", "cluster_id", (1 - dot("v", "representative")).alias("distance"))


#: Frames of a bin.
BIN = 64


def merge_edges(summary: DataFrame, limit: float, overlap: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of clusters, of one job if by names its columns, whose representatives are nearer than limit and whose frames overlap enough. overlap: above 0.

    Clusters meet in the bins that their frames fall into, each pair in the first bin that both are in.
    """
    cols = ["cluster_id", "representative", "first_frame", "last_frame"]
    at = lambda c: F.floor(F.col(c) / BIN)
    a, b = (summary.select(*by, *[F.col(c).alias(f"{c}_{s}") for c in cols], F.explode(F.sequence(at("first_frame"), at("last_frame"))).alias("bin")) for s in "ab")
    first = F.greatest(at("first_frame_a"), at("first_frame_b"))
    near = a.join(b, [*by, "bin"]).where((F.col("cluster_id_a") < F.col("cluster_id_b")) & (F.col("bin") == first))
    d = 1 - dot("representative_a", "representative_b")
    f = shared_frames(*[F.col(c) for c in ("first_frame_a", "last_frame_a", "first_frame_b", "last_frame_b")])
    return near.where((d < limit) & (f >= overlap)).select(*by, F.col("cluster_id_a").alias("a"), F.col("cluster_id_b").alias("b"), d.alias("distance"), f.alias("overlap"))


def _numbered(rows: DataFrame, by: tuple[str, ...], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """rows numbered from 0 in an order, within each job or over all."""
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return numbered(rows, order, name, scratch)


def merged(labels: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels after merging along edges, transitively, and numbered anew by the smallest old number, within each job if by names its columns."""
    scratch, keys = Scratch(labels.sparkSession, "merge"), [*by, "cluster_id"]
    nodes = scratch.cut(labels.where("cluster_id >= 0").groupBy(*keys).agg(F.min("det_id").alias("node")), "nodes")  # a crop stands for its cluster
    end = lambda c, n: nodes.select(*by, F.col("cluster_id").alias(c), F.col("node").alias(n))
    links = edges.select(*by, "a", "b").join(end("a", "u"), [*by, "a"]).join(end("b", "v"), [*by, "b"])
    comp = components(links.select("u", "v"), scratch, at_once=True)
    root = nodes.join(comp, "node", "left").select(*keys, F.coalesce("component", "node").alias("root"))
    old = root.groupBy(*by, "root").agg(F.min("cluster_id").alias("old"))
    new = root.join(_numbered(old, by, ["old"], "new", scratch), [*by, "root"]).select(*keys, F.col("new").cast("int").alias("new"))
    return labels.join(new, keys, "left").select(*by, "det_id", F.coalesce("new", "cluster_id").alias("cluster_id"))


def split_candidates(summary: DataFrame, frames: DataFrame, span: float, tight: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Clusters that last for more than a share of all frames and are loose. frames: by, total; one row without by."""
    share = (F.col("last_frame") - F.col("first_frame") + 1) / F.col("total")
    rows = summary.join(frames, list(by)) if by else summary.crossJoin(F.broadcast(frames))
    return rows.where((share > span) & (F.col("tightness") < tight)).select(*by, "cluster_id", share.alias("span"), "tightness")


def split(crops: DataFrame, labels: DataFrame, candidates: DataFrame, eps: float, min_samples: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels after clustering each candidate's members again with a smaller eps. Candidates that fall into two parts or more get new numbers after the largest (of their job), in order of cluster and part; their noise becomes -1."""
    scratch, keys = Scratch(labels.sparkSession, "split"), [*by, "old"]
    old = labels.join(candidates.select(*by, "cluster_id"), [*by, "cluster_id"], "left_semi").select("det_id", F.col("cluster_id").alias("old"))
    inside = crops.select(*by, "det_id", "v").join(old, "det_id")
    parts = scratch.cut(dbscan(inside, eps, min_samples, (*by, "old")).select(*keys, "det_id", F.col("cluster_id").alias("part")), "parts")
    several = parts.where("part >= 0").groupBy(*keys).agg(F.countDistinct("part").alias("n")).where("n >= 2")
    parts = parts.join(several, keys, "left_semi")
    top = labels.groupBy(*by).agg(F.max("cluster_id").alias("top"))
    fresh = parts.where("part >= 0").select(*keys, "part").distinct()
    fresh = _numbered(fresh.join(top, list(by)) if by else fresh.crossJoin(F.broadcast(top)), by, ["old", "part"], "at", scratch)
    fresh = fresh.select(*keys, "part", (F.col("at") + 1 + F.col("top")).cast("int").alias("new"))
    moved = parts.join(fresh, [*keys, "part"], "left").select("det_id", F.coalesce("new", F.lit(-1)).alias("moved"))
    return labels.join(moved, "det_id", "left").select(*by, "det_id", F.coalesce("moved", "cluster_id").alias("cluster_id"))


def coherent(crops: DataFrame, labels: DataFrame, p, by: tuple[str, ...] = ()) -> DataFrame:
    """Labels after both passes by time: clusters that are near and seen together merge, and loose ones that last for most of the frames are split. p: PipelineParams."""
    scratch = Scratch(crops.sparkSession, "coherent")
    summary = scratch.cut(summarize(crops, labels, by), "summary")  # read twice
    one = scratch.cut(merged(labels, merge_edges(summary, p.eps * p.merge_factor, p.merge_overlap, by), by), "merged")
    frames = crops.groupBy(*by).agg((F.max("frame_index") + 1).alias("total"))
    loose = scratch.cut(split_candidates(summarize(crops, one, by), frames, p.split_span, p.split_tightness, by), "loose")
    return split(crops, one, loose, p.split_factor * p.eps, p.min_samples, by)


def purity(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Majority labels' share of all labelled crops in clusters, null if there are none. truth: det_id, true_label."""
    per = labels.where("cluster_id >= 0").join(truth, "det_id").groupBy("cluster_id", "true_label").count()
    best = per.groupBy("cluster_id").agg(F.max("count").alias("best"), F.sum("count").alias("all"))
    return best.agg((F.sum("best") / F.sum("all")).alias("purity"))


def sweep(crops: DataFrame, pairs: DataFrame, grid: DataFrame, truth: DataFrame) -> DataFrame:
    """(eps, min_samples, noise, clusters, purity) for every point of a grid (point, eps, min_samples; a few rows). pairs: of the largest eps.

    Crops of all points are clustered at once: a crop of a point is a node of its own.
    """
    scratch = Scratch(crops.sparkSession, "sweep")
    n = grid.agg(F.max("point")).first()[0] + 1
    node = lambda c: F.col(c) * n + F.col("point")
    points = F.broadcast(grid)
    near = pairs.crossJoin(points).where(F.col("distance") <= F.col("eps"))
    near = scratch.cut(near.select("point", "min_samples", node("i").alias("i"), node("j").alias("j"), F.lit(0.0).alias("distance")), "pairs")
    every = crops.select("det_id").crossJoin(points).select("point", "min_samples", "det_id", node("det_id").alias("node"))
    least = near.select("min_samples", F.explode(F.array("i", "j")).alias("node")).groupBy("node", "min_samples").count().where("count + 1 >= min_samples").select("node")
    core = scratch.cut(least, "core")
    edges = near.join(core.withColumnRenamed("node", "i"), "i").join(core.withColumnRenamed("node", "j"), "j").select(F.col("i").alias("u"), F.col("j").alias("v"))
    comp = components(edges, scratch, at_once=True)
    roots = core.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    both = near.select(F.col("i").alias("node"), F.col("j").alias("other")).union(near.select("j", "i"))
    border = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("beside")), "other").groupBy("node").agg(F.min("beside").alias("beside"))
    labels = scratch.cut(every.join(roots, "node", "left").join(border, "node", "left").select("point", "det_id", F.coalesce("root", "beside").alias("cluster")), "labels")
    counts = labels.groupBy("point").agg(F.count_if(F.col("cluster").isNull()).alias("noise"), F.count_distinct("cluster").alias("clusters"))
    per = labels.where("cluster is not null").join(truth, "det_id").groupBy("point", "cluster", "true_label").count()
    best = per.groupBy("point", "cluster").agg(F.max("count").alias("best"), F.sum("count").alias("all")).groupBy("point").agg((F.sum("best") / F.sum("all")).alias("purity"))
    return points.join(counts, "point", "left").join(best, "point", "left").select("eps", "min_samples", "noise", "clusters", "purity")
