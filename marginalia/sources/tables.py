"""Tables: scans, tolerant projection, file facts, writers, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """Parquet at ``path``; only ``columns`` are read, rows with null in ``not_null`` are dropped."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.dropna(subset=not_null) if not_null else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer tasks than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_sql(spark: SparkSession, path: str, query: str, view: str = "source", **parameters) -> DataFrame:
    """``query`` over the Parquet files at ``path``, named ``view`` in it; values come as named parameters."""
    scan(spark, path).createOrReplaceTempView(view)
    return spark.sql(query, args=parameters)


def project_existing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The listed columns (name to type); null where ``df`` has none of that name."""
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def facts(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, columns): the count is answered from file footers where the source allows it."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(",".join(df.columns)).alias("columns")
    )


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """Zstandard Parquet; each task writes its own part, ``rows_per_file`` splits them further."""
    out = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """One id per line."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def publish(df: DataFrame, name: str, materialize: bool = False) -> None:
    """A view of that name, or a catalog table if ``materialize``."""
    if materialize:
        drop(df.sparkSession, name)
        df.write.mode("overwrite").option("compression", "zstd").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
