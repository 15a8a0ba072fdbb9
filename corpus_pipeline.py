"""A training corpus from ``documents``: each stage gets what its predecessor kept, written as Parquet and read again.

Stages but the last return the columns of ``documents``.  Nulls, empty texts and repeated rows are handled as each
operator's module states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import byte_bpe
from lexiforge.llm.common import materialise, table
from lexiforge.llm.decontaminate import clean
from lexiforge.llm.jaccard import one_of_each
from lexiforge.llm.personal_data import redact
from lexiforge.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from ``labels``."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word 5-grams at a similarity of 0.8 or more, that with the smallest id."""
    return one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of the text."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return byte_bpe.encode(rows, *byte_bpe.public_ranks(), few=True).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("encode", encode)]

#: SQL expresses neither the learned stages nor the transducer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, materialise(docs, STAGES[i - 1][0]) if i else docs, sf_dir)
    return docs
