"""JSON lines, one record per line, into one row per record.

Only objects are records: blank lines and lines that hold another JSON value are passed over, and a line that is
no JSON at all fails the read (``strict``) or is passed over. Scalars arrive as text. ``authors`` and ``shelves``
keep their JSON type, so that a list can be told from a text that looks like one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALARS = [
    "id", "work_id", "title", "description", "isbn", "isbn13", "language", "publication_date", "original_publication_date",
    "publisher", "rating_dist", "ratings_count", "average_rating", "num_pages", "text_reviews_count", "author_id", "author_name",
    "format", "edition_information", "image_url", "series_id", "series_name", "series_position",
]
SCHEMA = ", ".join(f"{c} string" for c in SCALARS) + ", authors variant, shelves variant"


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Records of the column ``value``."""
    whole = F.col("value").startswith("{") & F.col("value").endswith("}")
    trimmed = F.when(whole, F.col("value")).otherwise(F.trim(F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", "")))
    # As a generator's output a line is made and trimmed once, not again in each filter that looks at it.
    line = lines.select(F.inline(F.array(F.struct(trimmed.alias("value"))))).where("value <> ''")
    if strict:
        line = line.where(F.when(F.col("value").startswith("{"), F.lit(True)).otherwise(
            F.when(F.try_parse_json("value").isNotNull(), False).otherwise(F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 80))).cast("boolean"))
        ))
    else:
        line = line.where(F.col("value").startswith("{"))
    # The optimizer may parse before it filters; other lines must not reach the parser. As a generator's input the
    # record is parsed once, whatever number of its fields later filters look at.
    record = F.when(F.col("value").startswith("{"), F.col("value"))
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    if strict:
        return line.select(F.inline(F.array(F.from_json(record, SCHEMA, mode))))
    parsed = line.select(F.inline(F.array(F.from_json(record, SCHEMA + ", _bad string", mode))))
    return parsed.where("_bad is null").drop("_bad")


def read(spark: SparkSession, path: str, strict: bool = True, most: int | None = None) -> DataFrame:
    """Records of text files at ``path``; ``most`` limits the lines seen, before any filter."""
    lines = spark.read.text(path)
    return parse(lines.limit(most) if most is not None else lines, strict)
