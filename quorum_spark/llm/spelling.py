"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, grouped under their commonest form.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least LEAST_LENGTH code points and LEAST_COUNT
occurrences. The vocabulary's trie is joined with itself by active-node sets: each node carries the nodes within distance
one of it, a child's set follows from its parent's, and pairs are emitted where both nodes end words.

The trie is partitioned by prefixes. Two words at distance one, the shorter with m code points, have their first or their last
m // 2 code points in common, so a word goes to the subtree of its first half and, in the trie of reversed words, to that of
its last half, once as the shorter and once as the longer word. A subtree of more than SUBTREE words or NODES code points is
parted further, by the first or last half of what lies between, until no more than two code points do; so no key gathers an
unbounded group, whatever the words. A pair that both halves lead to is taken in the subtree of first halves.

Null and empty texts have no words. Repeated documents count as often as they stand. A null doc_id counts as an empty one where
the test's damage is made. Very long words are handled as others. No words or no near ones give no forms: a word is its own root
then. Ties in n are settled by code points. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.scratch import Scratch

LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
SUBTREE, NODES = 1 << 14, 1 << 19
#: Rows of a large subtree are spread over so many keys while it is parted.
SALTS = 32
RUN = "[a-zÀ-ÿ]+"
KEY = ["m", "pre", "suf", "below"]


def vocabulary(docs: DataFrame, damage: int | None = None, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n). damage: of runs whose crc32 of `doc_id:run` it divides, the code point at crc32 modulo length goes; None for none."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= length)
    word = F.col("run")
    if damage:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
        at = F.pmod(F.col("h"), F.length("run")).cast("int")
        word = F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _parted(rows: DataFrame) -> DataFrame:
    """Rows of subtrees in those of the first and the last half of what lies between prefix and suffix. A pair of a last half must differ before its first half ends (below)."""
    a, z = F.length("pre"), F.length("suf")
    half = F.floor((F.col("m") - a - z) / 2).cast("int")
    first = F.struct(F.substring("word", F.lit(1), a + half).alias("pre"), F.col("suf").alias("suf"), F.col("below").alias("below"))
    last = F.struct(F.col("pre").alias("pre"), F.substring("word", F.length("word") - z - half + 1, z + half).alias("suf"), (a + half).alias("below"))
    return rows.select("word", "n", "m", F.explode(F.array(first, last)).alias("s")).select("word", "n", "m", "s.*")


def subtrees(words: DataFrame, scratch: Scratch, most: int = SUBTREE, nodes: int = NODES) -> DataFrame:
    """(word, n, m, pre, suf, below): each word in every subtree where it can meet near ones, none of them larger than stated unless two code points at most are open."""
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"), F.lit("").alias("pre"), F.lit("").alias("suf"), F.lit(-1).alias("below")).where("m > 0")
    level, small = scratch.cut(_parted(whole), "subtrees"), []
    while True:
        open_points = F.col("m") - F.length("pre") - F.length("suf")
        large = level.groupBy(*KEY).agg(F.count("*").alias("size"), F.sum(open_points.cast("long")).alias("points")).where(((F.col("size") > most) | (F.col("points") > nodes)) & (open_points > 1))
        large = scratch.cut(large.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), F.lit(True).alias("large")), "large")
        if large.isEmpty():
            break
        told = level.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS))).join(large, [*KEY, "salt"], "left")
        small.append(told.where("large is null").select(level.columns))
        level = scratch.cut(_parted(told.where("large").select(level.columns)), "subtrees")
    for rows in small:
        level = level.union(rows)
    return level


def near_pairs(strings: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs i < j of distinct strings at distance one, by active-node sets of their trie."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, s in enumerate(strings):
        at = 0
        for c in s:
            child = children[at].get(c)
            if child is None:
                child = children[at][c] = len(children)
                children.append({})
                ends.append(-1)
            at = child
        ends[at] = i
    stack = [(0, 0, list(children[0].values()))]
    while stack:
        node, same, apart = stack.pop()  # `same` is the node itself, at distance none; those apart are at distance one
        if (i := ends[node]) >= 0:
            for v in apart:
                if ends[v] > i:
                    yield i, ends[v]
        kids = children[node]
        for c, child in kids.items():
            active = {node, *children[child].values()}
            active.update(w for e, w in kids.items() if e != c)
            active.update(children[v][c] for v in apart if c in children[v])
            active.discard(child)
            stack.append((child, child, list(active)))


def _met(key: tuple, words: list[str], ns: list[int]) -> tuple[list, list, list]:
    m, pre, suf, below = key
    near, of, n = [], [], []
    for i, j in near_pairs([w[len(pre) : len(w) - len(suf)] for w in words]):
        x, y = words[i], words[j]
        if len(x) > m and len(y) > m or below >= 0 and x[:below] == y[:below]:
            continue
        of += (x, y)
        near += (y, x)
        n += (ns[j], ns[i])
    return of, near, n


def _joined(batches):
    key, words, ns = None, [], []
    names = ["word", "near", "near_n"]
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*KEY, "word", "n")]
        out = ([], [], [])
        for *k, w, n in zip(*columns, strict=True):
            if k != key:
                if len(words) > 1:
                    for a, b in zip(out, _met(key, words, ns), strict=True):
                        a += b
                key, words, ns = k, [], []
            words.append(w)
            ns.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=names)
    if len(words) > 1:
        out = _met(key, words, ns)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=names)


def near_words(words: DataFrame, scratch: Scratch, most: int = SUBTREE, nodes: int = NODES) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of words at distance one."""
    rows = subtrees(words, scratch, most, nodes).select(*KEY, "word", "n")
    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_joined, "word string, near string, near_n long")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where links (word, form) lead to. Counts at least double from link to link, so chains are short and end; each round doubles the links that are followed."""
    table = scratch.cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while True:
        rows = table.select("word", "root")
        step = rows.select(F.col("word").alias("root"), F.col("root").alias("next"))
        told = rows.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        told = scratch.cut(told, "roots")
        scratch.drop(table)
        table = told
        if table.where("moved").isEmpty():
            return table.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, most: int = SUBTREE, nodes: int = NODES) -> DataFrame:
    """One row per word of (word, n): word, n, n_near, form, form_n, root. A form is the commonest near word if that is at least so many times as common."""
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.cut(words.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, scratch, most, nodes).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    rows = scratch.cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).cast("long").alias("form_n")), "forms")
    return rows.join(roots(rows.where("form is not null"), scratch), "word", "left").withColumn("root", F.coalesce("root", "word"))
