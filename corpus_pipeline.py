"""A training corpus from documents: five stages, each over all that the one before kept.

    toxicity    rows that the classifier chain calls toxic go
    exact       of equal texts (A-Z in lower case) the row with the largest id stays
    near        of near duplicates the row with the least id stays
    secrets     secrets in texts are replaced by their kind; every row stays
    packing     rows become pieces in sequences of 2048 tokens

All but the last return the columns of documents. Null texts count as empty; texts
that are null stay null until they are packed. No stage can be written in SQL (trained
models, tokenizers), so ORACLE_SQL is None; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exactdup, neardup, packing, secrets, toxicity
from tessera.llm.common import made, release, scratch, small_batches
from tessera.llm.queries import WORD_BPE, toxicity_chain


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.clean(docs, toxicity_chain(spark, sf_dir, docs), "toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return exactdup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.keep(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, where it was the text's length, is the new text's."""
    small_batches(spark)
    clean = secrets.redacted(docs, secrets.fit(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text").cast("long"), F.col("n_chars"))))
    return clean.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path(WORD_BPE), spell=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage made besides its output goes once that is written, and an output once the next one is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        before = made()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            done = [x for x in made() if x != path and not any(x is y or x == y for y in before)] + ([last] if last else [])
            if done:
                release(spark, *done)
            last = path
    return docs
