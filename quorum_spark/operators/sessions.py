"""Many sessions at once: each session's clusters against its own gallery, one to one, and its summary.

A session's clusters and gallery meet in one group of a task, which is what the assignment needs; sessions are spread over tasks.
`by` names the session's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.operators.matching import band, health, solve
from quorum_spark.params import PipelineParams


def _assigned(kinds: pa.Schema):
    """A session's clusters with their students: similarities in one product, the best total, and each cluster's best other student."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        left, right = left.sort_by("cluster_id"), right.sort_by("student_id")
        mine, own, other = ([None] * n for _ in range(3))
        if n and m:
            stack = lambda t, c: np.stack([np.asarray(x.values) for x in t.column(c)])
            s = stack(left, "representative") @ stack(right, "mean").T
            students = right.column("student_id").to_pylist()
            for r, c in solve(s):
                mine[r], own[r] = students[c], float(s[r, c])
                rest = np.delete(s[r], c)
                other[r] = float(rest.max()) if len(rest) else None
        keys = [left.column(k) for k in kinds.names[:-4]]
        return pa.Table.from_arrays([*keys, left.column("cluster_id"), *(pa.array(x, kinds.field(c).type) for x, c in ((mine, "student_id"), (own, "similarity"), (other, "runner_up")))], schema=kinds)

    return run


def matched(summary: DataFrame, gallery: DataFrame, p: PipelineParams, by: tuple[str, ...]) -> DataFrame:
    """(by, cluster_id, student_id, similarity, runner_up, decision), one row per cluster.

    Clusters and students of a session are assigned one to one with the largest total. Clusters beyond the students, and those of
    a session whose gallery is empty, have neither student nor similarity and are unmatched; an unmatched cluster's student is null.
    summary: by, cluster_id, representative; gallery: by, student_id, mean. Students of sessions without clusters give no row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    keys = list(by)
    left, right = summary.select(*keys, "cluster_id", "representative"), gallery.select(*keys, "student_id", "mean")
    kind = lambda t, c: (c, to_arrow_type(t.schema[c].dataType))
    arrow = pa.schema([*[kind(summary, k) for k in keys], kind(summary, "cluster_id"), kind(gallery, "student_id"), ("similarity", pa.float64()), ("runner_up", pa.float64())])
    names = "".join(f"`{k}` {summary.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{names}cluster_id {summary.schema['cluster_id'].dataType.simpleString()}, student_id {gallery.schema['student_id'].dataType.simpleString()}, similarity double, runner_up double"
    rows = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_assigned(arrow), schema)
    rows = rows.withColumn("decision", F.coalesce(band(F.col("similarity"), F.col("runner_up"), p), F.lit("unmatched")))
    return rows.withColumn("student_id", F.when(F.col("decision") != "unmatched", F.col("student_id")))


def summaries(decisions: DataFrame, roster: DataFrame, p: PipelineParams, by: tuple[str, ...], warned: DataFrame | None = None) -> DataFrame:
    """One row per session that has students or clusters: by, enrolled, present, review, absent, unrecognised, coverage, mean_similarity, health.

    Fails where present, review and absent don't add up to enrolled, as when a student is matched twice. roster: by, student_id;
    warned: by, warned, of sessions whose preflight may have warned.
    """
    keys = list(by)
    named = decisions.where("student_id is not null").groupBy(*keys, "student_id").agg(F.max(F.col("decision") == "confident").alias("sure"), F.max(F.col("decision") == "uncertain").alias("maybe"))
    both = roster.select(*keys, "student_id").distinct().join(named, [*keys, "student_id"], "left")
    counts = both.groupBy(*keys).agg(F.count("*").alias("enrolled"), F.count_if("sure").alias("present"), F.count_if("maybe").alias("review"), F.count_if(F.col("sure").isNull()).alias("absent"))
    other = decisions.groupBy(*keys).agg(F.count_if(F.col("decision") == "unmatched").alias("unrecognised"), F.avg(F.when(F.col("decision") == "confident", F.col("similarity"))).alias("mean_similarity"))
    out = counts.join(other, keys, "full").fillna(0, ["enrolled", "present", "review", "absent", "unrecognised"])
    flag = F.lit(False)
    if warned is not None:
        out, flag = out.join(warned.select(*keys, "warned"), keys, "left"), F.coalesce("warned", F.lit(False))
    adds_up = F.col("present") + F.col("review") + F.col("absent") == F.col("enrolled")
    out = out.withColumn("enrolled", F.when(adds_up, F.col("enrolled")).otherwise(F.raise_error(F.lit("the roster's parts do not add up"))))
    out = out.withColumn("coverage", F.when(F.col("enrolled") > 0, 100.0 * (F.col("present") + F.col("review")) / F.col("enrolled")).otherwise(0.0))
    return out.withColumn("health", health(F.col("coverage"), F.col("mean_similarity"), flag, p)).drop("warned")
