"""Near-duplicate documents by bottom-k sketches.

One hash function gives every distinct five-word shingle a 64-bit value. A document keeps its k smallest values. Inverted
lists of the retained values propose pairs, the k smallest values of both sketches together estimate their similarity,
and the full shingle sets decide.

How it keeps to size:
- Documents with the same set are one node, so copies meet nobody. Full sets are read from one document of each node.
- A pair of similarity 0.75 shares about 48 of 64 retained values. A document is listed only under its k - t + 1 rarest
  values, where t is the least overlap such a pair can be expected to have; any pair that shares t values still meets.
  Values of passages that very many documents share are a document's commonest, and so are not listed for it.
- Within a list documents are first compared with a few leaders, then only across components, so that a group of
  near copies costs its size and not its square. Pairs of one component need no check: links only matter for components.
- What is left of long lists (documents that share much, yet not enough) is compared block by block: products of small
  matrices rule pairs out, full sets decide the others in place, and only links that join components come out. A pair
  is decided in the first of the long lists that it shares.

The values t (29 of 64; 48 expected, deviation 3.5) and the margins below the threshold at which estimates drop a pair
(five deviations) are the only inexact steps; sets that a sketch holds whole are treated exactly. Measured
on planted pairs of 146 to 896 shingles with similarities just above 0.75 (tests): 400 of 400 found; pairs of 0.75 to 0.80 whose passages
40 and more other documents share are held to 99 % by a test as well. `retained` sets k: with k no smaller than the largest
set every step is exact, at the cost of lists of whole sets.

Null text, empty text and text without words have size 0 and link with nothing. Rows are answered one by one, each by its own
set, also where they repeat an id: its component is the smallest id of all rows whose sets it reaches, and its own. A null id is
its own component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum_spark.operators.graph import components
from quorum_spark.operators.scratch import Scratch, small_batches
from quorum_spark.llm.words import Words, give_back, pieces, shingle_sets

SHINGLE, RETAINED, PERCENT = 5, 64, 75
#: Deviations that an overlap or an estimate may fall short of what is expected at the threshold.
LISTED, MARGIN = 5.2, 5
#: Orders in which a list's later leaders are the smallest; several, so that documents of a group meet several leaders.
ORDERS = (0x0, 0x2AAAAAAAAAAAAAAA, 0x1999999999999999, 0x3C3C3C3C3C3C3C3C)
ROUNDS = 2
#: Lists of more members are compared in blocks of about BLOCK values (a megabyte), where sketches have HEAD values.
SHORT, BLOCK, HEAD = 32, 1 << 17, 256
#: Numbers of a matrix that is multiplied at once.
CELLS = 1 << 22


def _spread(k: int) -> float:
    """The deviation of a similarity at the threshold that k values estimate."""
    return math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / k)


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = list(shingle_sets(Words(part.column("text"), lower=True), SHINGLE))
                kept = [s[:k] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_key(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept), pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "sketch"],
                )

    return run


def _key(s: np.ndarray) -> bytes | None:
    """A set's own key, None for an empty one."""
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _full(batches):
    """The full set of each node, by the rows that its key was taken from."""
    seen = set()
    for batch in batches:
        for part in pieces(batch, "text"):
            rep, keys = part.column("rep").to_pylist(), part.column("set_key").to_pylist()
            sets = list(shingle_sets(Words(part.column("text"), lower=True), SHINGLE))
            own = [k for k, s in enumerate(sets) if rep[k] not in seen and _key(s) == keys[k]]
            own = list({rep[k]: k for k in own}.values())  # rows may be repeated
            seen.update(rep[k] for k in own)
            yield pa.RecordBatch.from_arrays([pa.array([rep[k] for k in own], pa.int64()), pa.array([sets[k].tobytes() for k in own], pa.binary())], names=["rep", "shingles"])


def _reach(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets reach the threshold."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _similar(batches):
    """Keeps the pairs whose full sets reach the threshold."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        keep = [_reach(*(np.frombuffer(z.as_buffer(), np.int64) for z in pair)) for pair in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep, pa.bool_())), batch.column("v").filter(pa.array(keep, pa.bool_()))], names=["u", "v"])


def _alike(n: str, m: str):
    """Whether sets of these sizes can be similar enough."""
    return f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", retained: int = RETAINED) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest document that similar pairs lead to), kept. retained: values of a sketch."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    sketched = scratch.cut(docs.mapInArrow(_sketch(retained), "doc_id long, text_hash long, n_shingles long, set_key binary, sketch array<bigint>"), "sketches")
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    classes = scratch.cut(classes.select("set_key", "first.*", F.monotonically_increasing_id().alias("rep")), "classes")
    reps = sketched.select("doc_id", "text_hash", "set_key", "n_shingles", "sketch").join(classes, ["doc_id", "text_hash", "set_key"])
    reps = scratch.cut(reps.groupBy("rep").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "reps")

    lists = scratch.cut(_lists(reps, retained), "lists")
    several = lists.groupBy("value").count().where("count > 1").select("value")
    listed = scratch.cut(lists.join(several, "value"), "several")
    needed = classes.join(listed.select("rep").distinct(), "rep", "left_semi")
    own = docs.join(needed, ["doc_id", "text_hash"]).select("text", "rep", "set_key")
    values = scratch.cut(own.mapInArrow(_full, "rep long, shingles binary"), "sets")

    links, tried, done = None, None, [lists, listed, values]
    comp = reps.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    for turn in range(ROUNDS + 1):
        members = listed.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
            "value", "rep", "n", "centre", F.coalesce("component", "rep").alias("c")
        )
        members = scratch.cut(members, "members")
        done.append(members)
        found = []
        if turn == ROUNDS:
            members = _mixed(members, scratch)
            found.append(_in_blocks(members, values, scratch, max(HEAD, retained)))
            done.append(members)
        pairs = _leaders(members, turn) if turn < ROUNDS else _few(members)
        pairs = pairs.where(_alike("nu", "nv")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = scratch.cut(pairs, "pairs")
        done.append(pairs)
        if not pairs.isEmpty():
            tried = pairs if tried is None else tried.union(pairs)
            with small_batches(spark, 64):  # a row has two full sets
                found.append(scratch.cut(_confirmed(_estimated(pairs, reps, retained), values), "links"))
        for new in found:
            links = new if links is None else links.union(new)
        if found:  # in between, only to spare comparisons, one round will do
            comp = components(links, scratch, None if turn == ROUNDS else 1)
    scratch.drop(*done)
    first = classes.select("set_key", "rep", F.col("doc_id").alias("first")).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    lows = first.where("component is not null").groupBy("component").agg(F.min("first").alias("low"))
    answers = scratch.cut(first.join(lows, "component", "left").select("set_key", F.coalesce("low", "first").alias("answer")), "answers")
    out = sketched.join(answers, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("answer", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept")
    )


def _lists(reps: DataFrame, k: int) -> DataFrame:
    """(value, rep, n, centre): every document under its rarest retained values, as many as any pair of the least overlap needs. centre: how often documents have its retained values."""
    postings = reps.select("rep", "n", F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    # sets of up to PERCENT of k have similar sets that are retained whole
    whole, part = F.ceil(F.col("n") * PERCENT / 100), math.floor(k * (PERCENT / 100 - LISTED * _spread(k)))
    least = F.when(F.col("n") <= k * PERCENT // 100, whole).otherwise(F.least(whole, F.lit(part)))
    ranked = postings.join(shared, "value").select(
        "value", "rep", "n", F.row_number().over(own.orderBy("df", "value")).alias("rank"), F.count("*").over(own).alias("shared"), F.sum("df").over(own).alias("centre")
    )
    # values of one document alone come first in the order and cannot meet
    alone = F.least("n", F.lit(k)) - F.col("shared")
    return ranked.where(F.col("rank") <= F.least("n", F.lit(k)) - least + 1 - alone).select("value", "rep", "n", "centre")


def _leaders(members: DataFrame, turn: int) -> DataFrame:
    """Every member of a list with the list's leader, unless they are in one component already.

    First the leader is the document whose values most documents have: copies that were changed in different places are
    all like their original, and not always like each other. Later it is the smallest in one of several orders.
    """
    k = len(ORDERS)
    mask = F.element_at(F.array(*[F.lit(x) for x in ORDERS]), (F.pmod(F.shiftright("value", turn * 8), F.lit(k)) + 1).cast("int"))
    merit = F.col("centre") if turn == 0 else -F.col("rep").bitwiseXOR(mask)
    lead = members.withColumn("merit", merit).groupBy("value").agg(F.max_by("rep", "merit").alias("v"), F.min("c").alias("low"), F.max("c").alias("high"))
    lead = lead.where("low < high").select("value", "v")
    lead = lead.join(members.select("value", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("c").alias("cv")), ["value", "v"])
    return members.select("value", F.col("rep").alias("u"), F.col("n").alias("nu"), "c").join(lead, "value").where("u <> v and c <> cv")


def _mixed(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The members of lists that hold several components, with the list's size, values in all and largest component (main)."""
    parts = members.groupBy("value", "c").agg(F.count("*").alias("size"), F.sum("n").alias("values"))
    lists = parts.groupBy("value").agg(F.max(F.struct("size", "c")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("size"), F.sum("values").alias("values"))
    lists = lists.where("parts > 1").select("value", "size", "values", F.col("most.c").alias("main"))
    return scratch.cut(members.join(lists, "value"), "mixed")


def _few(mixed: DataFrame) -> DataFrame:
    """All pairs of a list of up to SHORT members that are in different components."""
    short = mixed.where(F.col("size") <= SHORT)
    left = short.where("c <> main").select("value", F.col("rep").alias("u"), F.col("n").alias("nu"), "c")
    right = short.select("value", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("c").alias("cv"), "main")
    return left.join(right, "value").where("c <> cv and (cv = main or u < v)").select("u", "v", "nu", "nv")


def _in_blocks(mixed: DataFrame, sets: DataFrame, scratch: Scratch, head: int = HEAD) -> DataFrame:
    """Links that join the components of longer lists. head: values of a sketch here.

    A list's members are packed into blocks by a hash of the document; blocks of members outside the largest component
    are compared with all blocks.
    """
    long = mixed.where(F.col("size") > SHORT)
    of = long.groupBy("rep").agg(F.collect_list("value").alias("lists"))  # no more than a sketch holds
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("values") / BLOCK))
    rows = long.select("value", "rep", "n", "c", (F.col("c") != F.col("main")).alias("minor"), block.alias("block")).join(of, "rep").join(sets, "rep")
    packed = rows.groupBy("value", "block").agg(F.collect_list(F.struct("rep", "n", "c", "minor", "lists", "shingles")).alias("rows"))
    minor = packed.select("value", F.filter("rows", lambda r: r.minor).alias("left")).where("size(left) > 0")
    both = minor.join(packed.select("value", F.col("rows").alias("right")), "value")
    with small_batches(mixed.sparkSession, 8):  # a row of two blocks has megabytes
        return scratch.cut(both.mapInArrow(_near(head), "u long, v long"), "dense")


def _near(head: int):
    """From two blocks of a list the similar pairs that join components, no more than there are components.

    Overlaps of sketches are counted for all pairs at once; pairs that overlap enough are estimated by their union sketch,
    and those that pass are decided by their full sets.
    """

    def run(batches):
        low_share = PERCENT / 100 - MARGIN * _spread(head)
        for batch in batches:
            for value, left, right in zip(batch.column("value").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                a, b = ({k: side.values.field(k) for k in ("rep", "n", "c", "minor", "lists", "shingles")} for side in (left, right))
                (ra, na, ca), (rb, nb, cb) = (tuple(np.asarray(x[k]) for k in ("rep", "n", "c")) for x in (a, b))
                sa, sb = ([np.frombuffer(x.as_buffer(), np.int64) for x in side["shingles"]] for side in (a, b))
                la, lb = ([set(x) for x in side["lists"].to_pylist()] for side in (a, b))
                overlap = _overlap([x[:head] for x in sa], [x[:head] for x in sb], ra, rb)
                low, high = np.minimum(na[:, None], nb), np.maximum(na[:, None], nb)
                # a union sketch holds no more common values than both sketches share
                enough = overlap >= np.where(high <= head, PERCENT * (na[:, None] + nb) / (100 + PERCENT), low_share * np.minimum(low, head)) - 1e-9
                enough &= (ca[:, None] != cb) & (100 * low >= PERCENT * high) & (~np.asarray(b["minor"]) | (ra[:, None] < rb))
                above, links = {}, []
                for i, j in zip(*(x.tolist() for x in np.nonzero(enough)), strict=True):
                    x, y = _top(above, int(ca[i])), _top(above, int(cb[j]))
                    if x != y and min(la[i] & lb[j]) == value and _estimate(sa[i][:head], sb[j][:head], head) >= low_share and _reach(sa[i], sb[j]):
                        above[x] = y
                        links.append((ra[i], rb[j]))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])
            give_back()

    return run


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """The similarity of two sets by their union sketch: how many of its k smallest values both sketches hold."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    twice = np.flatnonzero(both[1:] == both[:-1])
    distinct = np.delete(both, twice + 1)[:k]
    return int((both[twice] <= distinct[-1]).sum()) / len(distinct)


def _top(above: dict, x: int) -> int:
    """The component that x was joined to last."""
    while x in above:
        if above[x] in above:
            above[x] = above[above[x]]
        x = above[x]
    return x


def _overlap(a: list[np.ndarray], b: list[np.ndarray], ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """How many values each of a's sets shares with each of b's, of values that several documents hold (ra, rb: which documents the sets are of).

    Products of slices of CELLS numbers are added up, so what is held follows the pairs and not the values.
    """
    va, vb = (np.concatenate(s) for s in (a, b))
    ia, ib = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b))
    v, r = np.concatenate([va, vb]), np.concatenate([ra[ia], rb[ib]])
    order = np.lexsort((r, v))
    v, r = v[order], r[order]
    other = (v[1:] == v[:-1]) & (r[1:] != r[:-1])
    both = np.intersect1d(np.intersect1d(va, vb), v[1:][other])
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for i, x in ((ia, va), (ib, vb)):
        at = np.searchsorted(both, x)
        hit = (at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == x) if len(both) else np.zeros(len(x), bool)
        by_value = np.argsort(at[hit], kind="stable")
        sides.append((i[hit][by_value], at[hit][by_value]))
    width = max(1, CELLS // max(len(a), len(b)))
    for low in range(0, len(both), width):
        part = []
        for (i, at), n in zip(sides, (len(a), len(b)), strict=True):
            lo, hi = np.searchsorted(at, (low, low + width))
            m = np.zeros((n, min(width, len(both) - low)), np.float32)
            m[i[lo:hi], at[lo:hi] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def _estimated(pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """The pairs whose union sketch doesn't rule out the threshold. Where one sketch holds each whole set, it decides exactly."""
    a = reps.select(F.col("rep").alias("u"), F.col("sketch").alias("a"))
    b = reps.select(F.col("rep").alias("v"), F.col("sketch").alias("b"))
    union = F.slice(F.array_sort(F.array_union("a", "b")), 1, k)
    share = F.size(F.array_intersect(F.array_intersect("a", "b"), "union")) / F.size("union")
    low = PERCENT / 100 - MARGIN * _spread(k)
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b", union.alias("union")).where(share >= low).select("u", "v")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("left"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("right"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(_similar, "u long, v long").distinct()
