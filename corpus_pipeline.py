"""The corpus pipeline: five stages over documents, each an operator of quirework.llm.

Each stage gets what the stage before it kept, reads it whole, and its decisions take effect. All but the last
return the columns of documents. run() writes each stage's result as Parquet to the folder of spark.checkpoint.dir
and reads it again, so a lost executor never costs more than the running stage.

Rules, of every stage: a null text is an empty one; empty and very long texts are rows like others; extra columns of any
name pass through all stages but the last; an empty table gives an empty one. Rows that repeat doc_id and text become
one in exact_dedup; rows that repeat a doc_id with different texts are documents of their own. A null doc_id is kept by
near_dedup whatever its text, and treated like any other elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import table, written
from quirework.llm.decontamination import drop_contaminated
from quirework.llm.exact_dedup import drop_copies
from quirework.llm.near_dedup import drop_near_copies
from quirework.llm.packing import pack_documents
from quirework.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity 0.8 or more), one document stays."""
    return drop_near_copies(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece."""
    pieces = pack_documents(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A network's scores and a tokenizer's ids are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
