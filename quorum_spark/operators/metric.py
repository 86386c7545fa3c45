"""Blocks of unit vectors that are near each other, and what can be found between them without listing pairs.

Rows: keys (such as the job), det_id, v. Within the keys' values vectors are dealt to the nearest of up to PIVOTS of their own, picked
by a cut of hashes, and cells are cut into blocks of about BLOCK. A block has a centre and the largest angle to it (its
ball). Angles obey the triangle inequality, so two blocks whose balls are further apart than the angle asked for hold no
pair, and never meet. Any pivots give the same results; they only decide what can be skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch, small_batches

BLOCK, PIVOTS, SALTS = 512, 1024, 16
#: Vectors of a tile, in which all are compared, and of a side of a rectangle; vectors of a product.
TILE, SIDE, STRIP = 4096, 16384, 4096
#: Up to so many vectors in all are packed as they come: pivots would cost more than they can spare.
FEW = 8 * BLOCK
#: Slack of angles: arc cosines near 1 are exact to about 1e-8.
SLACK = 1e-6
_CUTS = 1 << 40


def array_of(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """A list cell as an array, empty for null."""
    cell = batch.column(batch.schema.get_field_index(name))[row]
    return cell.values.to_numpy(zero_copy_only=False) if cell.is_valid else np.zeros(0)


def _beside(rows: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their keys' sizes. These are written first: where they are known to be few, vectors aren't sent by their keys, which would leave a job to one task."""
    if not keys:
        return rows.crossJoin(F.broadcast(sizes))  # one row
    return rows.join(Scratch(rows.sparkSession, "sizes").cut(sizes, "sizes"), keys)


def packs(rows: DataFrame, key: str, v: str, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, b, n, ids, v): about `block` vectors to a pack, dealt by a hash of key; n: rows of these keys."""
    sized = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = _beside(rows, sized, keys)
    b = F.pmod(F.xxhash64(key), F.floor(F.col("n") / block) + 1)
    return rows.groupBy(*keys, b.alias("b")).agg(F.any_value("n").alias("n"), F.collect_list(key).alias("ids"), F.flatten(F.collect_list(v)).alias("v"))


def _own(batch: pa.RecordBatch, keys: list[str], row: int, n: int = 1) -> list[pa.Array]:
    at = pa.array(np.full(n, row))
    return [batch.column(batch.schema.get_field_index(k)).take(at) for k in keys]


def _cells(keys: list[str]):
    """Each pack's vectors by their nearest pivot; pivots of a pack are those of its keys."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, p = (array_of(batch, c, r) for c in ("ids", "v", "pivots"))
                x = v.reshape(len(ids), -1)
                cell = (x @ p.reshape(-1, x.shape[1]).T).argmax(1) if len(p) else np.zeros(len(ids), int)
                order = np.argsort(cell, kind="stable")
                edge = np.flatnonzero(np.diff(cell[order], prepend=-1))
                parts = np.split(order, edge[1:])
                b = batch.column(batch.schema.get_field_index("b"))[r].as_py()
                yield pa.RecordBatch.from_arrays(
                    [*_own(batch, keys, r, len(parts)), pa.array(cell[order][edge], pa.int32()), pa.array([b] * len(parts), pa.int64()), pa.array([ids[k] for k in parts], pa.list_(pa.int64())), pa.array([x[k].ravel() for k in parts], pa.list_(pa.float64()))],
                    names=[*keys, "cell", "b", "ids", "v"],
                )

    return run


def _balls(keys: list[str]):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v = (array_of(batch, c, r) for c in ("ids", "v"))
                x = v.reshape(len(ids), -1)
                centre = x.mean(0)
                centre = centre / max(np.linalg.norm(centre), 1e-12)
                radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
                yield pa.RecordBatch.from_arrays([*_own(batch, keys, r), pa.array([ids], pa.list_(pa.int64())), pa.array([v], pa.list_(pa.float64())), pa.array([centre], pa.list_(pa.float64())), pa.array([radius])], names=[*keys, "ids", "v", "centre", "radius"])

    return run


def _ball_schema(kinds: str) -> str:
    return f"{kinds}ids array<long>, v array<double>, centre array<double>, radius double"


def few(rows: DataFrame) -> bool:
    return rows.count() <= FEW


def dealt(rows: DataFrame, scratch: Scratch, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, block, ids, v, centre, radius), written, of vectors as they come, where none are skipped."""
    keys = list(by)
    with small_batches(rows.sparkSession, 16):
        own = packs(rows, "det_id", "v", keys).select(*keys, "ids", "v").mapInArrow(_balls(keys), _ball_schema(_named(rows, keys)))
        return scratch.cut(own.withColumn("block", F.monotonically_increasing_id()), "blocks", large_rows=True)


def balls(rows: DataFrame, scratch: Scratch, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, block, ids, v, centre, radius), written."""
    keys = list(by)
    kinds = _named(rows, keys)
    rows = rows.where("v is not null").select(*keys, F.col("det_id").cast("long").alias("det_id"), "v")
    if few(rows):
        return dealt(rows, scratch, by)
    with small_batches(rows.sparkSession, 16):
        first = scratch.cut(packs(rows, "det_id", "v", keys), "packs", large_rows=True)
        wanted = F.least(F.floor(F.col("n") / BLOCK), F.lit(PIVOTS))
        some = F.filter(F.zip_with("ids", F.sequence(F.lit(0), F.size("ids") - 1), lambda i, k: F.struct(i.alias("i"), k.alias("k"))), lambda s: F.pmod(F.xxhash64(s.i, F.lit(7)), F.lit(_CUTS)) < F.floor(wanted * _CUTS / F.col("n")))
        dim = (F.size("v") / F.size("ids")).cast("int")
        chosen = first.where(wanted > 0).select(*keys, F.flatten(F.transform(some, lambda s: F.slice("v", s.k * dim + 1, dim))).alias("p"))
        pivots = chosen.groupBy(*keys).agg(F.flatten(F.collect_list("p")).alias("pivots"))
        if keys:  # salted, so that packs of one job are spread over tasks
            salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
            told = first.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))).join(pivots.select(*keys, "pivots", salt), [*keys, "salt"], "left")
        else:
            told = first.crossJoin(F.broadcast(pivots))  # PIVOTS or so
        pieces = told.select(*keys, "b", "ids", "v", "pivots").mapInArrow(_cells(keys), f"{kinds}cell int, b long, ids array<long>, v array<double>")
        pieces = scratch.cut(pieces, "pieces", large_rows=True)
        sizes = pieces.groupBy(*keys, "cell").agg(F.sum(F.size("ids")).alias("size"))
        chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / BLOCK))
        met = _beside(pieces, sizes, [*keys, "cell"]).groupBy(*keys, "cell", chunk.alias("chunk")).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("v")).alias("v"))
        out = met.select(*keys, "ids", "v").mapInArrow(_balls(keys), _ball_schema(kinds))
        blocks = scratch.cut(out.withColumn("block", F.monotonically_increasing_id()), "blocks", large_rows=True)
    scratch.drop(first, pieces)
    return blocks


def block_pairs(blocks: DataFrame, eps: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, b1, b2, skipped) with b1 <= b2 for all pairs of blocks of the same keys: whether their balls are further apart than a cosine distance of eps. Blocks meet by salted keys and without their vectors."""
    keys, theta = list(by), float(np.arccos(np.clip(1 - eps, -1, 1))) + SLACK
    salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    left = blocks.select(*keys, F.col("block").alias("b1"), F.col("centre").alias("c1"), F.col("radius").alias("r1"), F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"))
    right = blocks.select(*keys, F.col("block").alias("b2"), F.col("centre").alias("c2"), F.col("radius").alias("r2"), salt)
    dot = F.aggregate(F.zip_with("c1", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))) - F.col("r1") - F.col("r2") > theta
    return left.join(right, [*keys, "salt"]).where("b1 <= b2").select(*keys, "b1", "b2", (apart & (F.col("b1") != F.col("b2"))).alias("skipped"))


def between(pairs: DataFrame, blocks: DataFrame, kernel: Callable[[dict, dict, bool], Iterator[pa.RecordBatch]], schema: str, extra: tuple[str, ...] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """What a kernel yields for each pair of blocks (b1, b2). It gets both blocks as arrays ids, v (a row each) and the columns of extra, and whether they are the same block. keys: columns of pairs that are repeated for each row of the result."""
    side = lambda n: blocks.select(F.col("block").alias(f"b{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("ids", "v", *extra)])
    both = pairs.select(*keys, "b1", "b2").join(side(1), "b1").join(side(2), "b2")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = ({c: array_of(batch, f"{c}{n}", r) for c in ("ids", "v", *extra)} for n in "12")
                for s in (a, b):
                    s["v"] = s["v"].reshape(len(s["ids"]), -1)
                a["block"], b["block"] = (batch.column(batch.schema.get_field_index(c))[r].as_py() for c in ("b1", "b2"))
                for out in kernel(a, b, a["block"] == b["block"]):
                    yield pa.RecordBatch.from_arrays([*_own(batch, list(keys), r, out.num_rows), *out.columns], names=[*keys, *out.schema.names])

    kinds = "".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}, " for k in keys)
    return both.mapInArrow(run, f"{kinds}{schema}")


def near(a: dict, b: dict, same: bool, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are within eps, each pair once if the blocks are the same, and all distances."""
    d = 1 - a["v"] @ b["v"].T
    hit = d <= eps
    if same:
        hit &= a["ids"][:, None] != b["ids"]
    return hit, d


class Vectors:
    """Blocks of a table, one after the other: ids, v (a row each), mark, root and core (where there are such), at (where blocks begin), and the blocks' names and balls."""

    def __init__(self, table: pa.Table):
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.ids = flat("ids")
        self.v = flat("v").reshape(len(self.ids), -1)
        self.mark, self.root, self.core = (flat(c) if c in table.column_names else None for c in ("mark", "root", "core"))
        size = np.array([len(x) for x in table.column("ids")], np.int64)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.name = table.column("block").to_numpy()
        self.centre = flat("centre").reshape(len(size), -1)
        self.radius = table.column("radius").to_numpy()


def hits(a: Vectors, b: Vectors, eps: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, which are within eps, distances) for blocks whose balls are near enough; a vector isn't near itself."""
    theta = float(np.arccos(np.clip(1 - eps, -1, 1))) + SLACK
    near = np.arccos(np.clip(a.centre @ b.centre.T, -1, 1)) - a.radius[:, None] - b.radius <= theta
    for k in range(len(a.at) - 1):
        rows, all_cols = slice(a.at[k], a.at[k + 1]), np.flatnonzero(np.repeat(near[k], np.diff(b.at)))
        for start in range(0, len(all_cols), STRIP):
            cols = all_cols[start : start + STRIP]
            d = 1 - a.v[rows] @ b.v[cols].T
            hit = d <= eps
            hit &= a.ids[rows][:, None] != b.ids[cols]
            yield rows, cols, hit, d


def _named(rows: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)


def _grouped(batches: Iterator[pa.RecordBatch], own: list, keys: list[str], schema: pa.Schema) -> pa.Table:
    """One table of a group's result, with its keys in front."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return schema.empty_table()
    table = pa.Table.from_batches(held)
    for k, value in reversed(list(zip(keys, own, strict=True))):
        table = table.add_column(0, k, pa.array([value.as_py()] * table.num_rows, schema.field(k).type))
    return table.cast(schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _count(blocks: DataFrame, keys: list[str], name: str, per: int, least: int) -> DataFrame:
    """(keys, name): into how many parts of about `per` vectors the keys' blocks are dealt; up to `least` smaller ones for more tasks."""
    n = F.sum(F.size("ids"))
    parts = F.greatest(F.ceil(n / per), F.least(F.lit(least), F.ceil(n / 1024)))
    return blocks.groupBy(*keys).agg(parts.cast("long").alias(name))




def in_tiles(blocks: DataFrame, kernel: Callable[[Vectors, int, bool], Iterator[pa.RecordBatch]], schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """What kernel(vectors, tile, alone) yields for each tile of about TILE vectors of the same keys, after the keys; alone: the keys have no other tile."""
    keys = list(by)
    rows = _beside(blocks, _count(blocks, keys, "tiles", TILE, 1), keys).withColumn("tile", F.pmod(F.xxhash64("block"), F.col("tiles")))
    kinds = f"{_named(blocks, keys)}{schema}"
    arrow = _arrow(blocks.sparkSession, kinds)

    def run(key, table):
        return _grouped(kernel(Vectors(table), key[-1].as_py(), table.column("tiles")[0].as_py() == 1), key[:-1], keys, arrow)

    return rows.groupBy(*keys, "tile").applyInArrow(run, kinds)


def rectangles(left: DataFrame, right: DataFrame, kernel: Callable[[Vectors, Vectors], Iterator[pa.RecordBatch]], schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """What kernel(a, b) yields for all of left and right of the same keys, after the keys.

    Both are dealt to sides of about SIDE vectors, and each two sides meet in one group. A vector is sent once for every side of
    the other, so what is sent is the vectors times the other's sides, not a pair of blocks for every product. Right has more and
    smaller sides, for more tasks, only as far as the copies of left stay fewer than twice right.
    """
    keys = list(by)

    def sized() -> DataFrame:
        n, m = (t.groupBy(*keys).agg(F.sum(F.size("ids")).alias(c)) for t, c in ((left, "n"), (right, "m")))
        both = n.join(m, keys) if keys else n.crossJoin(m)
        more = F.least(F.lit(16), F.ceil(F.col("m") / 1024), F.floor(2 * F.col("m") / F.greatest("n", F.lit(1))))
        sides = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / SIDE))
        return both.select(*keys, sides("n").cast("long").alias("p"), F.greatest(sides("m"), more).cast("long").alias("q"))

    sizes = Scratch(left.sparkSession, "sides").cut(sized(), "sides")

    def sent(rows, own, other, mine, theirs):
        """rows with the number of their side, once for every side of the other table."""
        cols = rows.columns
        rows = (rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))).withColumn(own, F.pmod(F.xxhash64("block"), F.col(mine))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)))
        return rows.select(*[F.col(c).alias(c) for c in (*cols, "a", "b")])

    a, b = sent(left, "a", "b", "p", "q"), sent(right, "b", "a", "q", "p")
    kinds = f"{_named(left, keys)}{schema}"
    arrow = _arrow(left.sparkSession, kinds)

    def run(key, x, y):
        return _grouped(kernel(Vectors(x), Vectors(y)) if x.num_rows and y.num_rows else iter(()), key[:-2], keys, arrow)

    return a.groupBy(*keys, "a", "b").cogroup(b.groupBy(*keys, "a", "b")).applyInArrow(run, kinds)


#: Vectors of a side where pairs themselves are listed, which bounds a group's list.
LISTED = 4096


def squares(blocks: DataFrame, kernel: Callable[[Vectors, Vectors, bool], Iterator[pa.RecordBatch]], schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """What kernel(a, b, same) yields for each two sides of about LISTED vectors of the same keys, after the keys; two different sides meet once, and each side meets itself (same)."""
    keys = list(by)

    def sent(own, other, low, high):
        rows = _beside(blocks, _count(blocks, keys, "q", LISTED, 16), keys).withColumn(own, F.pmod(F.xxhash64("block"), F.col("q")))
        rows = rows.withColumn(other, F.explode(F.sequence(low, high)))
        return rows.select(*[F.col(c).alias(c) for c in (*blocks.columns, "a", "b")])

    a, b = sent("a", "b", F.col("a"), F.col("q") - 1), sent("b", "a", F.lit(0).cast("long"), F.col("b"))
    kinds = f"{_named(blocks, keys)}{schema}"
    arrow = _arrow(blocks.sparkSession, kinds)

    def run(key, x, y):
        same = key[-2].as_py() == key[-1].as_py()
        return _grouped(kernel(Vectors(x), Vectors(y), same) if x.num_rows and y.num_rows else iter(()), key[:-2], keys, arrow)

    return a.groupBy(*keys, "a", "b").cogroup(b.groupBy(*keys, "a", "b")).applyInArrow(run, kinds)


def picked(tiles: DataFrame, choose: Callable[[np.ndarray, int], np.ndarray], scratch: Scratch, by: tuple[str, ...] = ()) -> DataFrame:
    """The vectors of (by, block, tile, ids, v, centre, radius, root, core) that choose(core, tile) names, without the tile, written. Balls stay as they are."""
    keys = list(by)
    kinds = f"{_named(tiles, keys)}block long, ids array<long>, v array<double>, centre array<double>, radius double, root array<long>, core array<boolean>"

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, centre, root, core = (array_of(batch, c, r) for c in ("ids", "v", "centre", "root", "core"))
                use = choose(core.astype(bool), batch.column(batch.schema.get_field_index("tile"))[r].as_py())
                if use.any():
                    column = lambda x, kind: pa.array([x], pa.list_(kind))
                    yield pa.RecordBatch.from_arrays(
                        [*_own(batch, [*keys, "block"], r), column(ids[use], pa.int64()), column(v.reshape(len(ids), -1)[use].ravel(), pa.float64()), column(centre, pa.float64()), *_own(batch, ["radius"], r), column(root[use], pa.int64()), column(core[use].astype(bool), pa.bool_())],
                        names=[*keys, "block", "ids", "v", "centre", "radius", "root", "core"],
                    )

    with small_batches(tiles.sparkSession, 16):
        return scratch.cut(tiles.select(*keys, "block", "tile", "ids", "v", "centre", "radius", "root", "core").mapInArrow(run, kinds), "picked", large_rows=True)


def part(blocks: DataFrame, marks: DataFrame, scratch: Scratch, by: tuple[str, ...] = ()) -> DataFrame:
    """The blocks' vectors that have a mark (block, det_id, mark), with their marks, written. Balls stay as they are."""
    keys = list(by)
    told = scratch.cut(marks.groupBy("block").agg(F.collect_list("det_id").alias("named"), F.collect_list("mark").alias("marks")), "marks")  # a small one is known to be so
    rows = blocks.join(told, "block").select(*keys, "block", "ids", "v", "centre", "radius", "named", "marks")
    kinds = f"{_named(blocks, keys)}block long, ids array<long>, v array<double>, centre array<double>, radius double, mark array<long>"

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, v, centre, named, marks = (array_of(batch, c, r) for c in ("ids", "v", "centre", "named", "marks"))
                order = np.argsort(named)
                at = np.minimum(np.searchsorted(named[order], ids), len(order) - 1)
                use = named[order][at] == ids
                column = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [*_own(batch, [*keys, "block"], r), column(ids[use], pa.int64()), column(v.reshape(len(ids), -1)[use].ravel(), pa.float64()), column(centre, pa.float64()), *_own(batch, ["radius"], r), column(marks[order][at][use], pa.int64())],
                    names=[*keys, "block", "ids", "v", "centre", "radius", "mark"],
                )

    with small_batches(blocks.sparkSession, 16):
        return scratch.cut(rows.mapInArrow(run, kinds), "part", large_rows=True)
