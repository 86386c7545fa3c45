"""Ground truth, vectors and stage tables at the edges of the engine."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum_spark.operators.numbering import numbered
from quorum_spark.operators.scratch import Scratch, small_batches

REQUIRED = ["roll_number", "actually_present", "row_number", "seat_position", "wears_glasses", "notes"]


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Every truth.csv under path/*/, with session_id from its folder. Roll numbers stay text; true, 1 and yes are true."""
    raw = spark.read.csv(f"{path}/*/truth.csv", header=True, inferSchema=False)
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"truth.csv lacks {', '.join(missing)}")
    flag = lambda c: F.lower(F.trim(c)).isin("true", "1", "yes")
    return raw.select(
        F.regexp_extract(F.input_file_name(), "([^/]+)/truth\\.csv$", 1).alias("session_id"),
        "roll_number",
        flag(F.col("actually_present")).alias("actually_present"),
        F.col("row_number").try_cast("int").alias("row_number"),
        "seat_position",
        flag(F.col("wears_glasses")).alias("wears_glasses"),
        "notes",
    )


def write_truth(rows: DataFrame, path: str) -> None:
    """Rows that are decided; the commit of the output folder makes it all or nothing."""
    rows.where("actually_present is not null").write.mode("overwrite").csv(path, header=True)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats from a binary column."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's table by its declared schema, so that an empty one keeps its columns."""
    return spark.read.schema(schema).parquet(path)


def read_labels(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Two text columns of a csv file with a header, such as cluster_id and roll_number or det_id and true_label; rows without a value are left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    if missing := [c for c in (key, value) if c not in raw.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return raw.select(key, F.trim(value).alias(value)).where(F.col(value) != "")


def write_sweep(rows: DataFrame, path: str, order: str) -> None:
    """A sweep's few rows as one csv file, in order."""
    rows.orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def list_frames(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, frame_index) of files, numbered from 0 in order of path; what they hold isn't read."""
    found = spark.read.format("binaryFile").load(pattern).select("path")
    return numbered(found, ["path"], "frame_index", Scratch(spark, "frames")).select("path", "frame_index")


def _rows_of_npy(batches):
    """Each file's rows, as its own header says."""
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            raw = content.as_buffer()
            head = io.BytesIO(raw[:HEADER].to_pybytes())
            version = np.lib.format.read_magic(head)
            shape, fortran, dtype = np.lib.format.read_array_header_1_0(head) if version == (1, 0) else np.lib.format.read_array_header_2_0(head)
            if len(shape) != 2 or dtype.kind not in "fiu":
                raise ValueError(f"{path}: not rows of vectors")
            x = np.frombuffer(raw[head.tell() :], dtype, shape[0] * shape[1]).reshape(shape, order="F" if fortran else "C").astype(np.float32)
            for at in range(0, shape[0], ROWS):
                part = np.ascontiguousarray(x[at : at + ROWS])
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["path", "row", "v"])


#: Bytes of a file that hold its header at most; rows that are handed over at once.
HEADER, ROWS = 1 << 16, 4096


def read_npy(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, row, v) of two-dimensional .npy files of any sizes and number types, each by its own header."""
    with small_batches(spark, 1):  # a row is a file
        rows = spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(_rows_of_npy, "path string, row long, v array<float>")
        return Scratch(spark, "npy").cut(rows, "vectors")
