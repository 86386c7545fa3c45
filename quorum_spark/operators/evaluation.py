"""Evaluation: confusion counts and metrics, strata, sweeps, yield, clustering quality, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(actual: Column, predicted: Column) -> list[Column]:
    cells = {"tp": actual & predicted, "fp": ~actual & predicted, "fn": actual & ~predicted, "tn": ~actual & ~predicted}
    return [F.count_if(c).alias(k) for k, c in cells.items()]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b).otherwise(1)).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn, tn) with precision, recall, f1, accuracy; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + fn + tn)})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def stratified(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of counts and metrics per column and value, from one pass. rows: actual, predicted (boolean). Null values are left out."""
    strata = F.explode(F.array(*[F.struct(F.lit(c).alias("stratum"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")
    flat = rows.select("actual", "predicted", strata).where("s.value is not null")
    return metrics(flat.groupBy("s.stratum", "s.value").agg(*confusion(F.col("actual"), F.col("predicted"))))


def sweep(rows: DataFrame, value: str, thresholds: DataFrame) -> DataFrame:
    """Counts and metrics per threshold; predicted where value reaches it. thresholds: threshold, a few rows of parameters."""
    met = rows.crossJoin(F.broadcast(thresholds))
    return metrics(met.groupBy("threshold").agg(*confusion(F.col("actual"), F.col(value) >= F.col("threshold"))))


def best_f1(swept: DataFrame) -> DataFrame:
    """The row with the largest F1, of equal ones the lowest threshold."""
    return swept.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("threshold"), F.col("m.f1").alias("f1"))


def crop_yield(present: DataFrame, assigned: DataFrame) -> DataFrame:
    """Crops per present student: mean, students with none and their share. assigned: student_id, member_count."""
    sums = assigned.groupBy("student_id").agg(F.sum("member_count").alias("n"))
    per = present.select("student_id").distinct().join(sums, "student_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    zero = F.count_if(F.col("n") == 0)
    return per.agg(F.count("*").alias("students"), F.avg("n").alias("mean_crops"), zero.alias("without"), _ratio(zero, F.count("*")).alias("without_share"))


def clustering_quality(spots: DataFrame) -> DataFrame:
    """From spot labels (cluster_id, person): share of clusters with several people, and of people in several clusters."""
    c = spots.groupBy("cluster_id").agg(F.count_distinct("person").alias("n")).agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("conflicting"))
    p = spots.groupBy("person").agg(F.count_distinct("cluster_id").alias("n")).agg(F.count("*").alias("people"), F.count_if(F.col("n") > 1).alias("over_split"))
    out = c.crossJoin(p)
    return out.withColumns({"merge_rate": _ratio(F.col("conflicting"), F.col("clusters")), "purity": 1 - _ratio(F.col("conflicting"), F.col("clusters")), "over_split_rate": _ratio(F.col("over_split"), F.col("people"))})


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins, the last one closed; values outside are left out."""
    inside = rows.where(F.col(value).between(low, high))
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
