"""Printed reports of tables: ``python -m marginalia.plans.report PATH [--text COLUMN] [--key COLUMN]``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from ..operators.ranking import inspect, length_quantiles, sample_exact
from ..sources.tables import facts


def duration(seconds: float) -> str:
    """3725 as 1h 2m 5s; hours and minutes only where there are any."""
    hours, rest = divmod(int(round(seconds)), 3600)
    minutes, left = divmod(rest, 60)
    return " ".join([f"{hours}h"] * (hours > 0) + [f"{minutes}m"] * (hours > 0 or minutes > 0) + [f"{left}s"])


def report(df: DataFrame, key: str, text: str | None = None, head: int = 5, at: int = 1000, sample: int = 0, width: int = 200) -> dict[str, DataFrame]:
    """Facts, two slices in order of ``key`` and length quantiles of ``text``, as DataFrames; texts are cut to ``width``."""
    short = df.select(*[df[c].substr(1, width).alias(c) if t == "string" else df[c] for c, t in df.dtypes])
    first, later = inspect(short, key, dict(short.dtypes), head, at)
    out = {"facts": facts(df), "first": first, "later": later}
    if text:
        out["lengths"] = length_quantiles(df, text)
    if sample:
        out["sample"] = sample_exact(short, sample, key)
    return out


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("path")
    args.add_argument("--key", required=True)
    args.add_argument("--text")
    args.add_argument("--head", type=int, default=5)
    args.add_argument("--at", type=int, default=1000)
    args.add_argument("--sample", type=int, default=0)
    a = args.parse_args()
    began = time.time()
    spark = SparkSession.builder.getOrCreate()
    for name, df in report(spark.read.parquet(a.path), a.key, a.text, a.head, a.at, a.sample).items():
        print(name)
        df.show(50, truncate=False)
    print(f"took {duration(time.time() - began)}")


if __name__ == "__main__":
    main()
