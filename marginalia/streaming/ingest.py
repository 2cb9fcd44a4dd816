"""Books from JSON lines that keep arriving: the batch operators, run on micro-batches with exactly-once files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import books, validate
from ..sources.jsonl import parse


def valid_books(spark: SparkSession, path: str, files_per_trigger: int = 100, strict: bool = False, full_entities: bool = True) -> DataFrame:
    """A stream of flat rows of the valid records in text files under ``path``; no state is kept. As in the batch
    plan, all HTML entities are decoded unless ``full_entities`` is off."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return books(validate(parse(lines, strict)).where("reject_reason is null"), full_entities)


def write(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    out = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("compression", "zstd").outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start(path)
