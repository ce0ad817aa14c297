"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

quality rules -> near-duplicate removal -> benchmark decontamination -> secret redaction -> packing. Every stage but
the last returns the columns of documents; packing returns pieces of training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.llm import crf, omh, packing, quality, wumanber
from headwater.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null or empty text fails the base rules; repeated rows stay or go
    together; an empty table stays empty."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, of repeated rows as well; texts without words are classes of their own."""
    return omh.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; an empty benchmark removes none, a null text has no windows."""
    return wumanber.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; null texts stay null, n_chars follows, no row goes."""
    return crf.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, as pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or
    empty text is one piece of its end mark; an empty table has no pieces."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: Sketches, alignment, the random field and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
