"""Commit requests from devices that were offline: delivered at least once, in files, and each committed once.

A stream of files is taken in batches. A batch's outcomes and records go to partitions of its own number, which a repeated batch
overwrites; what earlier batches committed is read back from there, so requests that come again, in the same batch, in a
later one or in a later run, find their session committed by themselves and are replays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quorum_spark.operators import roster as R

OUTCOMES = "request_id string, session_id long, outcome string, unenrolled long, undecided long"
RECORDS = "request_id string, session_id long, student_id long, status string, source string, confidence double"


class CommitStream:
    """root: a folder for outcomes, records and the stream's progress. tables: sessions, roster, bands and decisions, as commit_outcomes takes them."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, DataFrame]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def _kept(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def outcomes(self) -> DataFrame:
        return self._kept("outcomes", OUTCOMES)

    def records(self) -> DataFrame:
        return self._kept("records", RECORDS)

    def _write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/{name}")

    def take(self, requests: DataFrame, batch: int) -> None:
        """One batch of requests (request_id, session_id); the same batch again has the same effect."""
        asked = requests.select("request_id", F.col("session_id").cast("long").alias("session_id")).distinct()
        before = self.outcomes().where((F.col("batch") != batch) & (F.col("outcome") == "committed")).select("session_id", F.col("request_id").alias("taken"))
        sessions = self.tables["sessions"].join(before, "session_id", "left")
        sessions = sessions.select("session_id", F.when(F.col("taken").isNotNull(), "committed").otherwise(F.col("status")).alias("status"), F.coalesce("taken", "commit_request").alias("commit_request"))
        found = R.commit_outcomes(asked, sessions, self.tables["roster"], self.tables["bands"], self.tables["decisions"])
        records = R.committed_records(found, self.tables["roster"], self.tables["bands"], self.tables["decisions"])
        kinds = lambda t, schema: t.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])
        self._write(kinds(records, RECORDS), "records", batch)  # records first: without an outcome they would be written again, and the same
        self._write(kinds(found, OUTCOMES), "outcomes", batch)

    def run(self, source: str, files_a_batch: int = 1000) -> None:
        """Takes all files of requests in source that no earlier run has taken."""
        stream = self.spark.readStream.schema("request_id string, session_id long").option("maxFilesPerTrigger", files_a_batch).json(source)
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
