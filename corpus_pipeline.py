"""A corpus pipeline: each stage calls one operator on what its predecessor kept.

A null text counts as empty in all stages and stays null until the last, where it has no tokens.
A null or empty text is never toxic, near another or contaminated, so its row stays; so does a
row with a null id. Equal rows (same id, same text) are one document: all stay or all go. Other
columns pass through all stages but the last. No documents: no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bytebpe, linededup, minhash, toxicity, winnowing
from rowloom.llm.session import new_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labels, rejects go."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, chain)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines near an earlier line go; every document stays, with n_chars of its new text (null of a null text)."""
    out = linededup.dedup_lines(docs).drop("n_lines", "n_kept_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least id; of ids that are all null, each."""
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return winnowing.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, decoded again as a check."""
    return bytebpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]

#: Fitted models, SimHash and tokenisers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = new_path(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{root}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
