"""Deterministic stand-ins for the engine's tables, projected from the driver's."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum_spark.operators.clustering import mean_vectors
from quorum_spark.params import PipelineParams

PARAMS = PipelineParams(eps=0.65, merge_factor=1.1, split_factor=0.95, match_threshold=0.25, match_margin=0.05, match_band=0.05)

#: A session of the stand-in has few crops, so its clusters are wider.
SESSION_PARAMS = replace(PARAMS, eps=0.74)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def crops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("det_id"),
        (F.col("vec_id") % 240).cast("int").alias("frame_index"),
        ((F.col("vec_id") * 7919 % 1000 + 1) / 1000.0).alias("quality_score"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
        "label",
    )


def gallery(spark: SparkSession, d: str) -> DataFrame:
    return mean_vectors(crops(spark, d), "label").withColumnRenamed("label", "student_id")


def session_crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops of many sessions: a label stands for a session here."""
    return crops(spark, d).where("label is not null").withColumnRenamed("label", "job_id")


def session_gallery(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, student_id, mean): three of four students are enrolled in a session, and nobody in session 9."""
    every = gallery(spark, d)
    enrolled = every.select("student_id").crossJoin(F.broadcast(every.select(F.col("student_id").alias("job_id"))))  # labels of the stand-in, ten
    return enrolled.where("(student_id * 3 + job_id) % 4 <> 0 and job_id <> 9").join(every, "student_id").select("job_id", "student_id", "mean")


def warned_sessions(spark: SparkSession, d: str) -> DataFrame:
    return session_crops(spark, d).select("job_id").distinct().select("job_id", (F.col("job_id") % 5 == 1).alias("warned"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    w = F.lit(20.0) + 2 * F.col("l_quantity")
    rows = table(spark, d, "lineitem").select(
        F.expr("l_orderkey div 8").alias("frame_index"),
        ((F.col("l_partkey") * 37) % 600).cast("double").alias("x1"),
        ((F.col("l_suppkey") * 53) % 400).cast("double").alias("y1"),
        w.alias("w"),
        (0.40 + ((F.col("l_partkey") * 13 + F.col("l_linenumber") * 7) % 60) / 100.0).alias("score"),
        (F.col("l_partkey") % 400).cast("double").alias("blur"),
        ((F.col("l_suppkey") * 37) % 256).cast("double").alias("brightness"),
        ((F.col("l_suppkey") % 21) - 10).alias("a"),
        (F.col("l_linenumber") - 4).alias("b"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    )
    x = lambda k: F.col("x1") + k * F.col("w")
    y = lambda k: F.col("y1") + k * F.col("w")
    marks = {"lx1": x(0.3), "ly1": y(0.35), "lx2": x(0.7), "ly2": y(0.35), "lx3": x(0.5 + F.col("a") * 0.03), "ly3": y(0.55 + F.col("b") * 0.06), "lx4": x(0.35), "ly4": y(0.75), "lx5": x(0.65), "ly5": y(0.75)}
    return rows.withColumns({"x2": x(1.0), "y2": y(1.0), **marks})


def ledger(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    status = F.when(F.col("o_orderstatus") == "F", "present").otherwise("absent")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("class_session_id"), F.col("o_custkey").alias("student_id"), status.alias("status"), before.alias("supersedes_id"))


def consents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "error"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("student_id"), F.col("ts").alias("granted_at"), F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return both.select("doc_id", (F.col("quality") == 1).alias("actual"), "n_chars", "lang", "source", "toxic", (F.col("n_chars") >= 1000).alias("predicted"))
