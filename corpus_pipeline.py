"""Corpus pipeline: quality, near-dedup, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage gets
it written as Parquet and read again.  All but the last return the columns of
``documents``.

Edge cases, alike in all stages: an empty table stays empty; columns that a stage does not need
pass through, whatever their names; rows are told apart by doc_id and text, so a repeated doc_id
is no repeated document.  What each stage does with nulls, empty and long texts, ties and repeated
rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import op1_quality, op2_bpe, op4_decontamination, op9_secrets, op10_simhash
from sparkveil.llm._common import table
from sparkveil.plans import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside its held-out fold, accepts (score 0.5 or more).

    Null and empty texts get the score of no features; repeated rows are judged alike; long texts whole.
    """
    return op1_quality.keep_good(docs, op1_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each component of near copies, by the SimHash contract's links (4 words, 4 of 64 bits).

    Null and word-less texts are copies of each other; of equal ids the least text digest stays, null ids come last; rows
    equal in id and text are one.
    """
    return op10_simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows: spans go, mostly contaminated documents go whole (more than half of the words hit).

    Null and word-less texts stay as they are; repeated rows are treated alike; items without an id count.
    """
    return op4_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by marks; null texts stay null, overlapping secrets become one mark."""
    return op9_secrets.clean(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every row; null texts have none."""
    return op2_bpe.encode(docs, keep_ids=True)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("secret scans", secrets), ("BPE encoding and decoding", token_ids)]

#: SQL cannot express the learned classifier, XXH64 or BPE; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = scratch.write(docs)
    return docs
