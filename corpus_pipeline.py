"""The corpus pipeline: rules, classifier, near-duplicates, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last return the
columns of ``documents``; the last returns the ids of every drawn document. Stages are written as parquet in between.

Defined cases: null and empty texts fail the base rules and go in the first stage; repeated rows are judged one by one,
and the third stage leaves one of them; an empty table, or one of which nothing is kept, gives an empty result; without
labelled rows the first stage applies its base rules only and the second keeps everything (every score is 0.5); extra
columns of ``documents`` pass through to the fourth stage's result. Tests: tests/llm/test_pipeline.py, stage by stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import byte_bpe, minhash, mixing, quality_classifier, quality_rules
from graphloom.llm.common import materialize, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest calibrated on labelled rows."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hashed n-gram classifier, learned from all labelled rows that are left, finds good."""
    return quality_classifier.filter_documents(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minhash.drop_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's draws in training order: a document that is drawn twice is there twice."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every draw: its ids, and the digest of what they decode to."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        vocabulary = f.read()
    return byte_bpe.code_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", bpe_stage),
]

#: Fitted models and BPE merges have no SQL form; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
