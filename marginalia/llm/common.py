"""Shared pieces of the corpus operators: checkpoints, Arrow access, text tables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.translate table: A-Z to a-z, all else unchanged.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: As LOWER; ASCII bytes other than letters and digits become spaces (bytes of non-ASCII letters stay).
ALNUM = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of our own is set only where the session names none.

    That is a temporary folder in a process of its own (master local), else a folder in the shared warehouse.
    """
    ctx = spark.sparkContext._jsc.sc()
    if ctx.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and re.fullmatch(r"local(\[.*\])?", ctx.master()):
            named = tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return ctx.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs that run inside send whole texts to Python in batches of ``rows`` at most; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row: the optimizer moves neither filters nor projections
    through a generator, so no later condition makes it compute them again."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """Adds a row id that is the same each time the same files are scanned."""
    return df.withColumn(name, F.monotonically_increasing_id())


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller slices, so that few texts are held as objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow text column in one array, and the n + 1 offsets of its rows; null becomes empty."""
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n, at = len(col), col.offset
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=at + n + 1)[at:]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]
