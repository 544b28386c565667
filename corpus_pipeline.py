"""A corpus from documents to token digests: toxicity, exact copies, near copies, mixing, encoding.

Each stage reads all rows its predecessor kept. The first four return the columns of ``documents``;
rows they reject are gone for those after. ``run`` writes each stage to the shared checkpoint folder and reads it again,
so a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from profilekit.llm import byte_bpe, exact_dedup, jaccard_join, mixing, toxicity
from profilekit.llm.queries import MIX, RANK_FILE, table
from profilekit.session import materialise, ship_package

#: Near copies share 80 % of their shingles of five words.
NEAR = jaccard_join.JoinParams(words=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not reject."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space) the one with the smallest id."""
    ship_package(spark)
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near copies the one with the smallest id."""
    ship_package(spark)
    return jaccard_join.keep_one_each(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights; one that several epochs take is repeated."""
    ship_package(spark)
    return mixing.mix(docs, MIX).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every row."""
    ship_package(spark)
    return byte_bpe.round_trip_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier and the similarity join have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
