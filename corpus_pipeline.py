"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Languages first (texts without letters go), then exact copies, near copies (one of each
group stays), benchmark contamination, and at last the encoding into token ids. Every stage
works on all that the one before kept and, but for the last, returns the columns of
documents as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklore.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from tracklore.llm.queries import vocabulary_path
from tracklore.llm.text_arrays import prepare
from tracklore.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode(docs, vocabulary_path("byte_bpe_50k.json"), carry=["doc_id"], with_decoded=False)
    return found.select("doc.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

# The language model and the tokenizer can't be written in SQL; tests compare the operators
# of the stages, not the whole, with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
