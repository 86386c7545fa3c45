"""Tables that cut a job's lineage, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, as in tests on one machine, a folder of our own. A cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quorum-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_rows(spark: SparkSession, most: int = 1000) -> None:
    """Lowers the session's rows of an Arrow batch, so that batches of long texts fit the Python workers."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= most:
        spark.conf.set(ARROW_ROWS, str(most))


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of a few rows for what runs inside, where a row has megabytes."""
    before = spark.conf.get(ARROW_ROWS)
    arrow_rows(spark, most)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


class Scratch:
    """Parquet tables of one operator call. `cut` writes and rereads a DataFrame, `drop` deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        arrow_rows(spark)

    def cut(self, df: DataFrame, name: str = "t", large_rows: bool = False) -> DataFrame:
        """large_rows: rows of megabytes, so row groups of 16 MB are closed in time."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        out = df.write.option("compression", "zstd")
        if large_rows:
            out = out.options(**{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
        out.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def put(self, content: bytes, name: str) -> str:
        """Writes a small file and returns its path."""
        path, files = self._path(f"{self.root}/{name}")
        out = files.create(path)
        try:
            for at in range(0, len(content), 1 << 16):  # a large argument would take many times its size in the driver
                out.write(content[at : at + (1 << 16)])
        finally:
            out.close()
        return path.toString()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path, files = self._path(table._scratch_path)
            files.delete(path, True)

    def _path(self, name: str) -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
