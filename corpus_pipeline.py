"""From raw documents to token counts: five stages, each an operator of chatloom.llm.

Each stage works on all rows that its predecessor kept. The first four return the columns of
documents; the last returns the encoding's digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import bpe, decontaminate, langid, ngram_jaccard, secret_scan
from chatloom.llm.shared import crc_mod, materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (no letters at all, or null) go, whether or not a language was learned."""
    sample = langid.training_sample(docs, crc_mod(F.col("doc_id"), 4) != 2)
    if not sample:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.identify(docs, sample, label_out="lid__label", score_out="lid__score")
    return judged.where(F.col("lid__label") != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and n_chars follows."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the learned language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
