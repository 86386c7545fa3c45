"""Documents to training tokens: each stage works on all that its predecessor kept.

Rows are judged by their own text. Null and empty texts are not toxic, hold no leak or personal data, and encode to no tokens;
rows without text and without an id all stay. Rows whose id is null or repeated are told apart by a key of their own.
Languages, sources and further columns may be null and may have any name; all stages but the last return the columns that they
got. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum_spark.llm import bpe, decontam, minhash, pii, toxicity
from quorum_spark.operators.scratch import Scratch


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    score = _free(docs, "score")
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), docs.columns, score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def _keyed(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a key of each row, written so that every reader sees the same keys, and the key's column. Ids may be null or repeated."""
    row = _free(docs, "_row_key")
    return Scratch(spark, name).cut(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; those without an id come last.

    Rows are compared, not ids: a row with a null id is a document like others and stays unless it is a near copy, and a row
    repeated under one id stays once, also if it has no words. Different texts under one id are different documents. Rows
    without words and without an id all stay.
    """
    keyed, row = _keyed(spark, docs, "near-copies")
    found = minhash.near_duplicates(keyed, row).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    rows = keyed.select(row, "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text")).join(found, row)
    alike, own = F.col("n_shingles") > 0, F.col("doc_id").isNull()
    group = F.when(alike | own, F.struct(F.col("component_id").alias("c"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("d"), F.lit(None).cast("string").alias("t")))
    group = group.otherwise(F.struct(F.lit(None).cast("long").alias("c"), F.col("doc_id").alias("d"), F.col("text").alias("t")))
    first = rows.groupBy(group.alias("g")).agg(F.min(F.struct(own.alias("own"), F.col("doc_id"), F.col(row))).alias("first"))
    return keyed.join(first.select(f"first.{row}"), row, "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, whether its id is null or repeated."""
    keyed, row = _keyed(spark, docs, "leaks")
    texts = keyed.select(F.col(row).alias("doc_id"), "text")
    leaks = decontam.find_leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(leaks, row, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, decoded_sha256 (of what the ids decode to)."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(docs, path, keep=("doc_id", "lang", "source")), path)
    return out.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256)}).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", redact_personal_data),
    ("encoding", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            scratch.drop(before)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
