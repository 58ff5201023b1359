"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``. Rows with null ids
pass the near-duplicate stage unseen; empty and null texts go in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import decontaminate, ngram_join, quality, secrets
from pitchlake.llm.common import shared_folder, table
from pitchlake.llm.queries import mixed


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts, so Python workers get a thousand of them at a time, not ten thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go."""
    small_batches(spark)
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("accepted").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, five words and a similarity of 0.8: of each group its least id stays."""
    small_batches(spark)
    found = ngram_join.join_similar(docs, size=5, percent=80)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return ngram_join.without(docs, gone, "doc_id")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents with a passage of a benchmark item go."""
    small_batches(spark)
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets are replaced by a mark; n_chars follows."""
    found = secrets.scan(docs)
    text = secrets.redacted(F.col("text"), F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the mix, with the number of copies of each document."""
    return mixed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("source mix", mix_sources),
]

#: The first stage's model is not a matter of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
