"""The training-corpus pipeline: five stages, each written as Parquet and read again by the next.

ORACLE_SQL is None: a fitted field, hashed sketches and a tokenizer are beyond SQL, so tests/llm/test_pipeline.py
holds the stages, one after the other, against brute-force versions on a small corpus.

Every stage bears nulls, empty and very long texts, repeated rows, empty tables and further columns: a null or empty text is
clean, loses nothing, has no near copies, is never taken by the mix; a null doc_id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtally.llm.bpe import encode_documents
from gridtally.llm.line_dedup import drop_repeats
from gridtally.session import work_folder
from gridtally.llm.mixing import draw
from gridtally.llm.near_dedup import BROADCAST_IDS, near_classes
from gridtally.llm.texts import table, vocabulary
from gridtally.llm.toxicity import keep_clean, trained


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted on the labelled rows, doesn't reject."""
    return keep_clean(docs, trained(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs go from the texts; n_chars follows the text."""
    out = drop_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least id."""
    gone = near_classes(docs).filter("not kept").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return draw(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their digest and that of the decoded text."""
    return encode_documents(docs, vocabulary("word_bpe_49k.json"), with_decoded=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
