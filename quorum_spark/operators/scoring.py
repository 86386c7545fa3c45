"""Scores of sessions against the truth by roll number, per session and over all; similarities within and between people."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum_spark.functions.vectors import dot, norm, normalize
from quorum_spark.operators.evaluation import confusion, metrics
from quorum_spark.operators import metric
from quorum_spark.operators.numbering import numbered
from quorum_spark.operators.products import products
from quorum_spark.operators.scratch import Scratch

CELLS = ("tp", "fp", "fn", "tn")
#: Rows of a product.
ROWS = 256


def predictions(gallery: DataFrame, matches: DataFrame) -> DataFrame:
    """(session_id, student_id, predicted) for every gallery student: whether a confident match names them; uncertain ones don't count."""
    sure = matches.where("decision = 'confident' and student_id is not null").select("session_id", "student_id").distinct().withColumn("predicted", F.lit(True))
    return gallery.select("session_id", "student_id").distinct().join(sure, ["session_id", "student_id"], "left").select("session_id", "student_id", F.coalesce("predicted", F.lit(False)).alias("predicted"))


def on_truth(truth: DataFrame, predicted: DataFrame, students: DataFrame) -> DataFrame:
    """truth (session_id, roll_number, ...) with student_id and predicted, both null for roll numbers that the session's gallery lacks."""
    by_roll = predicted.join(students.select("student_id", "roll_number"), "student_id")
    return truth.join(by_roll, ["session_id", "roll_number"], "left")


def mapped(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that have a prediction, and those to warn of, which are never scored."""
    return scored.where(F.col("predicted").isNotNull()), scored.where(F.col("predicted").isNull())


def failures(scored: DataFrame) -> DataFrame:
    """(session_id, student_id, roll_number, kind): FN for present and not predicted, FP for absent and predicted."""
    kind = F.when(F.col("actually_present") & ~F.col("predicted"), "FN").when(~F.col("actually_present") & F.col("predicted"), "FP")
    return scored.select("session_id", "student_id", "roll_number", kind.alias("kind")).where(F.col("kind").isNotNull())


def session_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Confusion counts per session and further columns. scored: actually_present, predicted."""
    return scored.groupBy("session_id", *by).agg(*confusion(F.col("actually_present"), F.col("predicted")))


def summed(counts: DataFrame, *by: str) -> DataFrame:
    """Counts summed over sessions, and metrics of the sums."""
    return metrics(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in CELLS], F.count_distinct("session_id").alias("sessions")))


def macro(per_session: DataFrame, *columns: str) -> DataFrame:
    """The mean over sessions of each column; sessions where it is null don't count for it."""
    return per_session.agg(F.count_distinct("session_id").alias("sessions"), *[F.avg(c).alias(c) for c in columns])


def session_sweep(truth: DataFrame, best: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per session and threshold the confusion counts, a student being predicted from a similarity of threshold on. truth: session_id, student_id, actually_present; best: session_id, student_id, similarity; thresholds: a few rows."""
    rows = truth.join(best, ["session_id", "student_id"], "left").crossJoin(F.broadcast(thresholds))
    hit = F.coalesce(F.col("similarity") >= F.col("threshold"), F.lit(False))
    return rows.groupBy("session_id", "threshold").agg(*confusion(F.col("actually_present"), hit))


def resumed(roster: DataFrame, truth: DataFrame) -> DataFrame:
    """The roster with earlier labels by session and roll number; labels of unknown roll numbers are ignored. roster: session_id, student_id, roll_number."""
    return roster.join(truth.select("session_id", "roll_number", "actually_present"), ["session_id", "roll_number"], "left")


def present_students(roster: DataFrame, truth: DataFrame) -> DataFrame:
    return roster.join(truth.where("actually_present").select("session_id", "roll_number"), ["session_id", "roll_number"], "left_semi")


def cosine(a: str, b: str):
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def within_pairs(vectors: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, similarity) of all pairs of one key's vectors, of which a person has a handful."""
    a = vectors.select(key, F.col(ordinal).alias("i"), F.col("v").alias("a"))
    b = vectors.select(key, F.col(ordinal).alias("j"), F.col("v").alias("b"))
    return a.join(b, key).where("i < j").select(key, cosine("a", "b").alias("similarity"))


def within_extremes(vectors: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, similarity): the smallest and largest of all pairs of one key's vectors, a few rows for each key. Pairs are products of matrices in place, so people may have any number of vectors."""
    rows = vectors.where(F.col(key).isNotNull() & F.col("v").isNotNull()).select(key, F.col(ordinal).cast("long").alias("det_id"), "v")
    blocks = metric.dealt(rows, Scratch(vectors.sparkSession, "within"), (key,))
    return metric.rectangles(blocks, blocks, _extremes, "similarity double", (key,))


def _extremes(a: metric.Vectors, b: metric.Vectors):
    """The smallest and largest cosine of two sides' pairs, nothing where there is none. NaN counts as the largest, as in Spark, and hides no other value."""
    size, low, high = np.linalg.norm(b.v, axis=1), np.inf, -np.inf
    for start in range(0, len(a.ids), ROWS):
        x, ids = a.v[start : start + ROWS], a.ids[start : start + ROWS]
        s = x @ b.v.T
        s /= np.linalg.norm(x, axis=1)[:, None] * size + 1e-12
        other = ids[:, None] != b.ids
        low, high = np.fmin(low, np.fmin.reduce(s, axis=None, initial=np.inf, where=other)), np.maximum(high, s.max(initial=-np.inf, where=other))
    if high != -np.inf:
        yield pa.RecordBatch.from_arrays([pa.array([low if low < np.inf else high, high])], names=["similarity"])


def permuted(x: Column, bits: int, seed: int) -> Column:
    """A one-to-one mapping of the numbers below 2 ** bits, an even number of bits, by four rounds of keyed hashes of half a number."""
    half = bits // 2
    mask = F.lit((1 << half) - 1)
    left, right = F.shiftright(x, half), x.bitwiseAND(mask)
    for k in range(4):
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed), F.lit(k), right).bitwiseAND(mask))
    return F.shiftleft(left, half).bitwiseOR(right)


def drawn(spark: SparkSession, total: int, wanted: int, seed: int) -> DataFrame:
    """(t): so many different numbers below total, fewer than there are, drawn in the order of a keyed permutation."""
    bits = max(2, (total - 1).bit_length() + (total - 1).bit_length() % 2)
    upto = min(1 << bits, (wanted << bits) // total * 2 + 64)
    while True:
        rows = spark.range(upto).select("id", permuted(F.col("id"), bits, seed).alias("t")).where(F.col("t") < total)
        if upto == 1 << bits or rows.count() >= wanted:
            return rows.orderBy("id").limit(wanted).select("t")
        upto = min(1 << bits, upto * 2)


def unranked(t: Column) -> tuple[Column, Column]:
    """The pair i < j of number t, in the order (0, 1), (0, 2), (1, 2), (0, 3) and so on."""
    below = lambda j: F.shiftright(j * (j - 1), 1)
    j = F.floor((1 + F.sqrt(1 + 8 * t.cast("double"))) / 2).cast("long")
    j = F.when(below(j) > t, j - 1).otherwise(j)  # roots are doubles
    j = F.when(below(j + 1) <= t, j + 1).otherwise(j)
    return (t - below(j)).alias("i"), j.alias("j")


def key_means(vectors: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(id, v), written: the plain means of keys, whole numbers, scaled to length 1."""
    flat = vectors.where(F.col(key).isNotNull()).select(key, F.posexplode("v").alias("k", "x")).groupBy(key, "k").agg(F.avg("x").alias("x"))
    means = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m"))
    return scratch.cut(means.select(F.col(key).cast("long").alias("id"), normalize(F.transform("m", lambda s: s.x)).alias("v")), "means")


def between_extremes(vectors: DataFrame, key: str) -> DataFrame:
    """(similarity): the smallest and largest of all pairs of the plain means of keys, whole numbers, a few rows for each two sides. Pairs are products of matrices in place, none is left out and none is listed."""
    scratch = Scratch(vectors.sparkSession, "between")
    blocks = metric.dealt(key_means(vectors, key, scratch).withColumnRenamed("id", "det_id"), scratch)
    return metric.rectangles(blocks, blocks, _extremes, "similarity double")


def between_pairs(vectors: DataFrame, key: str, sampled: int | None = None, seed: int = 0) -> DataFrame:
    """(i, j, similarity) with i < j of the plain means of keys, whole numbers: all pairs, or, for who asks for a sample, `sampled` different ones drawn at random if there are more.

    All pairs come from block products; a sample's are numbers of pairs, so nothing grows with the square of the keys.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType
    scratch = Scratch(spark, "between")
    means = key_means(vectors, key, scratch)
    n = means.count()
    if sampled is None or sampled >= n * (n - 1) // 2:
        pairs = products(means, means, _above, "i long, j long, similarity double")
    else:
        place = scratch.cut(numbered(means.select("id"), ["id"], "at", scratch), "places").join(means, "id")
        side = lambda at, name, v: place.select(F.col("at").alias(at), F.col("id").alias(name), F.col("v").alias(v))
        chosen = drawn(spark, n * (n - 1) // 2, sampled, seed).select(*[c.alias(f"at_{x}") for c, x in zip(unranked(F.col("t")), "ij", strict=True)])
        pairs = chosen.join(side("at_i", "i", "a"), "at_i").join(side("at_j", "j", "b"), "at_j").select("i", "j", dot("a", "b").alias("similarity"))
    return pairs.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "similarity")


def _above(i, j, s):
    p, q = np.nonzero(i[:, None] < j)
    yield pa.RecordBatch.from_arrays([pa.array(i[p]), pa.array(j[q]), pa.array(s[p, q])], names=["i", "j", "similarity"])


def overlap(within: DataFrame, between: DataFrame) -> DataFrame:
    """(low, high) where both distributions of similarity have values, null if nowhere. Their extremes are enough."""
    a = within.agg(F.min("similarity").alias("a0"), F.max("similarity").alias("a1"))
    b = between.agg(F.min("similarity").alias("b0"), F.max("similarity").alias("b1"))
    low, high = F.greatest("a0", "b0"), F.least("a1", "b1")
    both = F.col("a0").isNotNull() & F.col("b0").isNotNull() & (high > low)
    return a.crossJoin(b).select(F.when(both, low).alias("low"), F.when(both, high).alias("high"))


def range_histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, low, n) over equal bins from the smallest value to the largest, the last one closed; one value alone has half a unit on each side."""
    span = rows.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    span = span.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("lo")) / step), F.lit(bins - 1))
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(b.alias("bin"), (F.col("lo") + b * step).alias("low")).agg(F.count("*").alias("n"))


def every_nth(rows: DataFrame, place: str, n: int) -> DataFrame:
    return rows.where(F.col(place) % n == 0)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows, the same for a seed whatever the partitioning: the first in an order by a hash of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
