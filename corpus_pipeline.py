"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, token files.

``run(spark, sf_dir)`` applies the stages to ``documents``. Each stage is written as
Parquet and read again as the next one's input. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import mixing, positional, probminhash, quality, token_files
from tallyweave.llm.common import id_order, table, without
from tallyweave.llm.registry import TOKENIZER
from tallyweave.session import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line frequencies keep, without their lines above the limits."""
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each class."""
    return probminhash.first_of_classes(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than a twentieth of benchmark passages."""
    found = positional.hits(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return without(docs, found.select(id_order("_raw").alias("_id"), "_h"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, those taken twice twice."""
    return mixing.mixed(docs, mixing.plan_mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and one row for each document in them."""
    return token_files.token_files(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", mix_sources),
    ("token files", token_ids),
]

#: Token ids can't be made in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
