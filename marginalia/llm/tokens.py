"""Labelled samples and cached per-word lookups for the two text models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, materialize

#: Words whose value a task remembers; beyond that the memory starts anew.
REMEMBER = 1 << 18


class Remember(dict):
    """value(word), computed once while the word is remembered."""

    def __init__(self, value: Callable[[bytes], int | float]):
        super().__init__()
        self.value = value

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBER:
            self.clear()
        out = self[word] = self.value(word)
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """(text, y): at most ``most`` labelled documents, the first in an order of hashed ids, the same each time.

    The ids are broadcast (at most ``most`` of them), so only the sample's texts are shuffled. ``keep`` is a
    condition on doc_id. Labels that are null or not 0 or 1 are left out; of repeated labels the largest holds;
    of documents that share an id one is taken, the one with the smallest text.
    """
    ids = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return materialize(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y"))


def is_held_out(modulus: int, remainder: int) -> Column:
    return id_remainder(F.col("doc_id"), modulus) == remainder
