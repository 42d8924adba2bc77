"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is masked, sources are mixed, texts become tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import bpe, likeness, mixing, pii, toxicity
from tidebar.llm.common import shared_dir, table

#: Scores from here on are toxic; a source may be repeated so many times as often as another.
TOXIC_FROM, MAX_REPEAT = 0.3, 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model, trained on the labels, scores under the threshold; without a lexicon all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not model.weights:
        return docs
    return docs.where(toxicity.score_column(F.col("text"), model) < TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of five-word likeness 0.8 or more connect; SimHash links first, then what it can't see."""
    return likeness.representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind in brackets; ``n_chars`` follows the new text."""
    masked = docs.withColumn("text", pii.redact_column(F.col("text"), pii.train(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources as often as the temperature asks, within the repetition limit."""
    return mixing.mix(docs, mixing.plan(docs, entropy_between=mixing.ENTROPY_BETWEEN, max_repeat=MAX_REPEAT)).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with their number and digests."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage is written to the shared folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


ORACLE_SQL = None
