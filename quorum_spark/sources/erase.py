"""Deletion of people's rows from tables of files, copy on write.

A table is a folder of Parquet files and of manifests, each a list of the files that make up a version. A deletion finds the files
that hold rows of the people concerned, rewrites only these, and switches to a new version by one manifest; all other
files keep their names. Without such rows nothing is written. A deletion that fails before its manifest is complete leaves
the former version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ErasableTable:
    """root: a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last complete manifest, 0 if there is none."""
        path, files = self._path(f"{self.root}/manifest")
        if not files.exists(path):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return max((int(n.removeprefix("v")) for n in names if files.exists(self._path(f"{self.root}/manifest/{n}/_SUCCESS")[0])), default=0)

    def files(self) -> list[str]:
        """Names of the current version's files, below root. Spark's readers take them from the driver as well."""
        version = self.version()
        return sorted(r["value"] for r in self.spark.read.text(f"{self.root}/manifest/v{version:08d}").collect()) if version else []

    def _commit(self, names: list[str]) -> None:
        rows = self.spark.createDataFrame([(n,) for n in names], "value string")
        rows.coalesce(1).write.text(f"{self.root}/manifest/v{self.version() + 1:08d}")  # fails if another writer was first

    def _written(self, rows: DataFrame) -> list[str]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        path, files = self._path(f"{self.root}/{folder}")
        return [f"{folder}/{s.getPath().getName()}" for s in files.listStatus(path) if s.getPath().getName().startswith("part-")]

    def append(self, rows: DataFrame) -> None:
        self._commit([*self.files(), *self._written(rows)])

    def read(self, names: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in (self.files() if names is None else names)])

    def erase(self, ids: DataFrame, key: str) -> DataFrame:
        """Deletes the rows of ids (key) and returns how many went: (key, removed), one row for each id, also for those without rows."""
        ids = ids.select(key).distinct()
        names = self.files()
        if not names:
            return ids.withColumn("removed", F.lit(0).cast("long"))
        mine = self.read(names).select(key, F.col("_metadata.file_path").alias("file")).join(ids, key, "left_semi")
        found = mine.groupBy("file", key).agg(F.count("*").alias("n"))
        found.write.parquet(log := f"{self.root}/audit/{uuid.uuid4().hex}")  # counts before anything is switched
        found = self.spark.read.schema(found.schema).parquet(log)
        touched = {"/".join(r["file"].split("/")[-3:]) for r in found.select("file").distinct().collect()}
        if touched:
            kept = self.read(sorted(touched)).join(ids, key, "left_anti")
            self._commit([*(n for n in names if n not in touched), *self._written(kept)])
        return ids.join(found.groupBy(key).agg(F.sum("n").alias("removed")), key, "left").fillna(0, ["removed"])


def erase_student(tables: dict[str, ErasableTable], ids: DataFrame, key: str = "student_id") -> DataFrame:
    """Deletes ids from several tables: (key, table, removed), for the audit. Tables are switched one by one; running it again finishes what was left."""
    out = None
    for name, table in tables.items():
        counts = table.erase(ids, key).select(key, F.lit(name).alias("table"), "removed")
        out = counts if out is None else out.unionByName(counts)
    return out
