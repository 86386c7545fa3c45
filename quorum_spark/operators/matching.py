"""Clusters against a gallery: similarities, one-to-one assignment, bands, rosters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum_spark.operators.products import all_products, products
from quorum_spark.params import PipelineParams


def _sides(reps: DataFrame, gallery: DataFrame) -> tuple[DataFrame, DataFrame]:
    return reps.select(F.col("cluster_id").alias("id"), F.col("representative").alias("v")), gallery.select(F.col("student_id").alias("id"), F.col("mean").alias("v"))


def similarities(reps: DataFrame, gallery: DataFrame) -> DataFrame:
    """(cluster_id, student_id, similarity) for all pairs, where these are asked for. reps: cluster_id, representative; gallery: student_id, mean."""
    found = all_products(*_sides(reps, gallery))
    return found.select(F.col("i").cast(reps.schema["cluster_id"].dataType).alias("cluster_id"), F.col("j").cast(gallery.schema["student_id"].dataType).alias("student_id"), F.col("s").alias("similarity"))


def top_matches(reps: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """(cluster_id, student_id, similarity, rank) of each cluster's k best gallery entries; equal similarities in order of student_id.

    A pair of packs is one matrix product, of which k entries for each cluster are kept.
    """

    def kernel(i, j, s):
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, best.shape[1])), pa.array(j[best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["cluster_id", "student_id", "similarity"])

    kind = lambda t, c: t.schema[c].dataType.simpleString()
    found = products(*_sides(reps, gallery), kernel, f"cluster_id {kind(reps, 'cluster_id')}, student_id {kind(gallery, 'student_id')}, similarity double")
    return ranked(found, k)


def ranked(sims: DataFrame, k: int, key: str = "cluster_id") -> DataFrame:
    """Each key's k best entries; equal similarities in order of student_id."""
    order = Window.partitionBy(key).orderBy(F.desc("similarity"), "student_id")
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def band(similarity: Column, runner_up: Column, p: PipelineParams) -> Column:
    margin = similarity - F.coalesce(runner_up, F.lit(0.0))
    sure = (similarity >= p.match_threshold) & (margin >= p.match_margin)
    return F.when(sure, "confident").when(similarity >= p.match_threshold - p.match_band, "uncertain").otherwise("unmatched")


def solve(total: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the one-to-one assignment with the largest sum, by shortest augmenting paths."""
    flip = total.shape[0] > total.shape[1]
    cost = -(total.T if flip else total)
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, seen, back = cost[row] - u[row] - v, np.zeros(m, bool), np.full(m, row)
        shift_rows, col = {row: 0.0}, -1
        while True:
            col = int(np.where(seen, np.inf, dist).argmin())
            seen[col] = True
            least = dist[col]
            if owner[col] < 0:
                break
            i = int(owner[col])
            shift_rows[i] = least
            other = least + cost[i] - u[i] - v
            better = ~seen & (other < dist)
            dist[better], back[better] = other[better], i
        for i, d in shift_rows.items():
            u[i] += least - d
        v[seen] -= least - dist[seen]
        while True:
            i = int(back[col])
            owner[col], before = i, np.flatnonzero(owner == i)
            before = [c for c in before if c != col]
            if i == row:
                break
            col = before[0]
    return sorted((c, int(r)) if flip else (int(r), c) for c, r in enumerate(owner) if r >= 0)


def assign(sims: DataFrame, job: str) -> DataFrame:
    """(job, cluster_id, student_id, similarity): for each job the assignment with the largest total. A job's matrix is small; jobs are spread over tasks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="cluster_id", columns="student_id", values="similarity")
        pairs = solve(m.to_numpy())
        return pd.DataFrame({job: pdf[job].iloc[0], "cluster_id": [m.index[r] for r, _ in pairs], "student_id": [m.columns[c] for _, c in pairs], "similarity": [m.iat[r, c] for r, c in pairs]})

    kinds = ", ".join(f"{c} {sims.schema[c].dataType.simpleString()}" for c in (job, "cluster_id", "student_id"))
    return sims.groupBy(job).applyInPandas(one, f"{kinds}, similarity double")


def decide(sims: DataFrame, assigned: DataFrame, p: PipelineParams, clusters: DataFrame | None = None) -> DataFrame:
    """One row per cluster: similarity of its assigned student, best similarity of any other, band; no student where unmatched.

    clusters: cluster_id of all clusters; those that no gallery entry was compared with, as with an empty gallery, are unmatched.
    """
    mine = assigned.select("cluster_id", F.col("student_id").alias("mine"), F.col("similarity").alias("own"))
    every = sims.select("cluster_id").distinct() if clusters is None else clusters.select("cluster_id").distinct()
    rows = every.join(sims, "cluster_id", "left").join(mine, "cluster_id", "left").groupBy("cluster_id").agg(
        F.max("mine").alias("mine"), F.max("own").alias("similarity"), F.max(F.when(F.col("student_id") != F.col("mine"), F.col("similarity"))).alias("runner_up")
    )
    rows = rows.withColumn("decision", band(F.col("similarity"), F.col("runner_up"), p))
    return rows.select("cluster_id", F.when(F.col("decision") != "unmatched", F.col("mine")).alias("student_id"), "similarity", "runner_up", "decision")


def health(coverage: Column, mean_similarity: Column, warned: Column, p: PipelineParams) -> Column:
    poor = (coverage < p.health_poor_coverage) | (mean_similarity.isNotNull() & (mean_similarity < p.health_min_similarity)) | warned
    return F.when(F.coalesce(poor, F.lit(False)), "poor").when(coverage < p.health_fair_coverage, "fair").otherwise("good")


def session_summary(decisions: DataFrame, roster: DataFrame, warned: bool, p: PipelineParams) -> DataFrame:
    """One row: enrolled, present, review, absent, unrecognised, coverage, mean_similarity, health. Fails unless present, review and absent add up to enrolled."""
    students = roster.select("student_id").distinct()
    per = decisions.where("student_id is not null").groupBy("student_id").agg(F.max(F.col("decision") == "confident").alias("sure"))
    both = students.join(per, "student_id", "left")
    counts = both.agg(F.count("*").alias("enrolled"), F.count_if("sure").alias("present"), F.count_if(~F.col("sure")).alias("review"), F.count_if(F.col("sure").isNull()).alias("absent"))
    other = decisions.agg(F.count_if(F.col("decision") == "unmatched").alias("unrecognised"), F.avg(F.when(F.col("decision") == "confident", F.col("similarity"))).alias("mean_similarity"))
    out = counts.crossJoin(other)
    out = out.withColumn("coverage", F.when(F.col("enrolled") > 0, 100.0 * (F.col("present") + F.col("review")) / F.col("enrolled")).otherwise(0.0))
    adds_up = F.col("present") + F.col("review") + F.col("absent") == F.col("enrolled")
    out = out.withColumn("enrolled", F.when(adds_up, F.col("enrolled")).otherwise(F.raise_error(F.lit("the roster's parts do not add up"))))
    return out.withColumn("health", health(F.col("coverage"), F.col("mean_similarity"), F.lit(warned), p))


def majority_vote(crops: DataFrame, gallery: DataFrame, threshold: float, votes: int) -> DataFrame:
    """(student_id, votes, present): crops vote for their best entry if it is similar enough. Every gallery student has a row."""
    best = top_matches(crops.select(F.col("det_id").alias("cluster_id"), F.col("v").alias("representative")), gallery, 1)
    given = best.where(F.col("similarity") >= threshold).groupBy("student_id").agg(F.count("*").alias("votes"))
    n = F.coalesce("votes", F.lit(0))
    return gallery.select("student_id").join(given, "student_id", "left").select("student_id", n.alias("votes"), (n >= votes).alias("present"))
