"""A corpus from documents: quality, near-duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Null and empty texts are documents like others: the classifier scores them, they are copies of each other, they
hold no part of a benchmark, and they weigh nothing in the mix. Texts of any length are read whole. Repeated rows
are copies; a null doc_id or source is kept (null ids last, null sources as one source). An empty table stays
empty through every stage.
``run`` writes each stage's result to the shared checkpoint folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, mixing, quality, sharding, simhash
from marginalia.llm.common import materialize
from marginalia.llm.tokens import is_held_out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled documents of the input.

    Without usable labels every score is 0.5 and every document goes.
    """
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~is_held_out(4, 2))
    return quality.drop_rejected(docs, weights)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id, ties to the first row."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of 13 words of a benchmark item (or any whole shorter item)."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one that isn't taken goes, none is taken over 3 times."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document, one row for each that the mix took."""
    return sharding.digest(sharding.shard(docs))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier, SimHash and the cube draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
