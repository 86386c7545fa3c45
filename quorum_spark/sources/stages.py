"""Stage tables that are kept by job, and which jobs have to run again.

A run's rows are written first, sorted by job into files of many jobs; then the manifest tells of each of these jobs: job_id, params_hash,
run, item_count. A run of few jobs replaces their partitions of the manifest, one of many appends to one table, so files follow the
rows and not the jobs; a job's latest entry counts. Readers take the runs that it names, so a run that fails halfway
leaves the former result, other jobs are never touched, and jobs without rows have a result, too, an empty one.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

MANIFEST = "params_hash string, run string, item_count long, at long, stage string, job_id long"
#: Up to so many jobs of a run have a partition of the manifest each.
SINGLE = 32


def chained_hashes(stages: dict[str, list[Column]]) -> dict[str, Column]:
    """For each stage, in order, the sha256 of its own parameters as JSON and of the hash before it, so a change redoes all that follows."""
    out, before = {}, F.lit("")
    for stage, columns in stages.items():
        before = F.sha2(F.concat(F.to_json(F.struct(*columns)), before), 256)
        out[stage] = before
    return out


def expected(jobs: DataFrame, stages: dict[str, list[Column]]) -> DataFrame:
    """(job_id, stage, position, params_hash) of every job and stage. jobs: job_id and the columns of parameters."""
    hashes = chained_hashes(stages)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(k).alias("position"), h.alias("params_hash")) for k, (s, h) in enumerate(hashes.items())]))
    return jobs.select("job_id", each.alias("s")).select("job_id", "s.*")


def due(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stages of jobs without a result of the hash that is wanted. As hashes are chained, all that follow a changed one are due."""
    return wanted.join(manifest.select("job_id", "stage", "params_hash"), ["job_id", "stage", "params_hash"], "left_anti")


def write_stage(rows: DataFrame, path: str) -> None:
    """rows by job_id; of the jobs in them the former rows are replaced, other jobs keep theirs."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


class StageStore:
    """Stage tables below one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        """(job_id, stage, params_hash, run, item_count) of what is there. Manifests that can't be read count as missing, so their jobs are due."""
        rows = reduce(DataFrame.unionByName, [self._entries(name) for name in ("manifest", "runs")])
        last = rows.groupBy("job_id", "stage").agg(F.max_by(F.struct("params_hash", "run", "item_count"), F.coalesce("at", F.lit(0))).alias("last"))
        return last.select("job_id", "stage", "last.*")

    def _entries(self, name: str) -> DataFrame:
        try:
            return self.spark.read.option("ignoreCorruptFiles", "true").schema(MANIFEST).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def write(self, stage: str, rows: DataFrame, jobs: DataFrame) -> None:
        """rows (job_id, ...) are the stage's result for all of jobs (job_id, params_hash), also for those without rows."""
        run = uuid.uuid4().hex
        kept = rows.withColumn("job_id", F.col("job_id").cast("long")).join(jobs.select("job_id").distinct(), "job_id", "left_semi").select(*rows.columns)
        kept.repartitionByRange("job_id").sortWithinPartitions("job_id").write.parquet(f"{self.root}/data/{stage}/run={run}")
        written = self.spark.read.schema(kept.schema).parquet(f"{self.root}/data/{stage}/run={run}")
        counts = written.groupBy("job_id").agg(F.count("*").alias("item_count"))
        out = jobs.select("job_id", "params_hash").join(counts, "job_id", "left").fillna(0, ["item_count"])
        out = out.select(F.col("params_hash"), F.lit(run).alias("run"), F.col("item_count").cast("long"), F.lit(time.time_ns()).alias("at"), F.lit(stage).alias("stage"), F.col("job_id").cast("long"))
        if jobs.limit(SINGLE + 1).count() > SINGLE:
            out.write.mode("append").parquet(f"{self.root}/runs")
        else:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "job_id").parquet(f"{self.root}/manifest")

    def read(self, stage: str, schema: str) -> DataFrame:
        """The stage's rows of all jobs, as their manifests say. schema: with job_id; an empty stage keeps its columns."""
        current = self.manifest().where(F.col("stage") == stage).select("job_id", "run")
        runs = [r["run"] for r in current.select("run").distinct().collect()]  # names of runs
        if not runs:
            return self.spark.createDataFrame([], schema)
        kinds = T.StructType([T.StructField(f.name, T.LongType()) if f.name == "job_id" else f for f in T._parse_datatype_string(schema)])
        tables = [self.spark.read.schema(kinds).parquet(f"{self.root}/data/{stage}/run={run}").withColumn("run", F.lit(run)) for run in runs]
        return reduce(DataFrame.unionByName, tables).join(current, ["job_id", "run"]).select(*kinds.names)
