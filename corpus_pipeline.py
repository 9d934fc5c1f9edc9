"""A corpus pipeline of the llm operators over ``documents``. Part of the llm subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinework.llm import decontaminate, mixing, near_dups, token_files, toxicity
from brinework.llm.common import discard, free_name, swept, table
from brinework.llm.queries import MIX, mix_domain

#: A model and hashed candidates have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, 0.8 or more."""
    return near_dups.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weights, each document at most once."""
    new = {k: free_name(docs, f"_mixed_{k}") for k in ("domain_as", "tokens_as", "epoch_as")}
    return mixing.mix(docs, mix_domain(), weights=MIX["weights"], seed=MIX["seed"], budget_share=0.9, max_epochs=1, **new).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of what is left, and one row of their contents for each document."""
    path = token_files.shared_path(spark, "corpus")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; what a stage read is deleted once
    the next is written, and what it checkpointed once it is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = token_files.shared_path(spark, f"stage-{name}")
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
