"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from quillpath.llm import decontam, ngram_join, packing, pii, quality
from quillpath.llm.common import among, counted, only_ids, written
from quillpath.llm.queries import table, tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.3; the others go."""
    return quality.scored(docs, table(spark, sf_dir, "labels"), 0.3).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by a Jaccard similarity of 0.8 or more of their shingles of
    five words, the one with the smallest doc_id. Rows that share a doc_id stay or go together."""
    classes = ngram_join.similar(docs, 5, Fraction(4, 5))
    return among(docs, *counted(classes.where("doc_id <> component_id").select("doc_id")), "doc_id", how="left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item by 0.8 or more of its shingles."""
    return only_ids(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")), "doc_id", how="left_anti").select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in text replaced by its kind and n_chars to match."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 ids."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), 2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii_redaction),
    ("best-fit packing", packing_stage),
]

#: The classifier has no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
