"""A training corpus from the table of documents: classify, deduplicate, decontaminate, scan, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import decontaminate, mixing, quality_classifier, secrets, similar
from sievelight.llm.common import read, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says that they are of quality; the fit leaves out the labels of the fold kept for tests.

    Rows are judged one by one: equal texts alike, null and empty ones by the score of no words, null ids like others.
    """
    labels = read(spark, sf_dir, "labels")
    model = quality_classifier.fit_quality(docs, labels.where(quality_classifier.fold(5) != 0))
    return quality_classifier.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a similarity of 0.8 or more of five-word shingles links two.

    The least id stays, nulls last; ids play no part in what is a copy.  Texts without words are one group.
    """
    return similar.drop_similar(docs).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Rows are told apart by id and text, so of rows with one id, or with none, only those that hold a passage go.
    """
    docs, row = docs.select(*COLUMNS), F.xxhash64("doc_id", "text")
    named = docs.select(F.struct("doc_id", row.alias("row")).alias("doc_id"), "text")
    leaks = decontaminate.find_leaks(named, read(spark, sf_dir, "benchmark")).select(F.col("doc_id.doc_id").alias("_leak"), F.col("doc_id.row").alias("_row")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_leak")) & (row == F.col("_row"))
    return docs.join(leaks, same, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars counts what is left."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how many of their words it takes."""
    return mixing.mix_sources(docs.select(*COLUMNS)).where("taken > 0")


STAGES = [
    ("quality_classifier", classify),
    ("near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scans", redact_secrets),
    ("mixing", mix),
]

#: No stage but the last can be said in SQL: tests/llm/test_pipeline.py holds each against brute force on a small table.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What each hands over is written to the shared folder and removed once the next one is written; what the last stage
    reads stays, as its rows are computed when they are asked for.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _drop(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
