"""Delimited strings as sets."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_set(c: Column, separator: str = r"\|") -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), separator), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0.0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))
