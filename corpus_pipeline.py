"""A cleaned, mixed and encoded training corpus from `documents`, stage by stage.

Every stage is written as Parquet in the shared folder and read again by the
next, so a lost executor repeats a part of one stage only. What a stage wrote
for itself goes once its rows are written.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakewright.llm import chunk_bpe, mixing, rules, simhash, substrings
from lakewright.llm.common import give_back
from lakewright.session import cut_lineage, release_scratch, scratch_mark, ship, small_batches

#: What scratch tables there were before the stage that ran last.
_before: dict[str, int] = {}


def stage(function):
    """A stage, which first removes the inner tables of the one before it: that one's rows are written by now."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        own = spark.sparkContext.applicationId
        if own in _before:
            release_scratch(spark, _before[own], keep=docs)
        _before[own] = scratch_mark(spark)
        give_back()
        return function(spark, docs, sf_dir)
    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; it learns from `labels` and the texts at hand."""
    return rules.drop_poor(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more stays."""
    return simhash.drop_near_copies(docs, words=5, similarity=0.8)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out of the later ones."""
    return substrings.cut_repeats(docs, 13)


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are used again, up to twice, every document once at least; the written files carry the mixture's order."""
    return mixing.in_order(docs)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the digests of the ids and of the text decoded from them."""
    return chunk_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixture", mixture), ("encoded", encoded)]

#: The stages hold a trained model, fingerprints and a tokenizer, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = scratch_mark(spark)
    for name, function in STAGES:
        docs = cut_lineage(function(spark, docs, sf_dir), name)
        release_scratch(spark, before, keep=docs)
        _before.pop(spark.sparkContext.applicationId, None)
    return docs
