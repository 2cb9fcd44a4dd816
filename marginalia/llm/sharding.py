"""Shards by a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only.

A document's place on the ring is the hash of its text, so equal texts lie together. Each shard holds many
virtual nodes; a document goes to the first one clockwise whose shard isn't full. With a capacity of exactly
its part of the rows per shard, counts differ by one at most; with ``slack`` above 0 fewer documents move when
shards are added.

The ring is cut into 2 ** ``CELL_BITS`` cells. Only the number of rows in each cell goes to the driver (a bounded
table); the clockwise walk there yields, for each cell, the shards that its rows fall to and from which rank.
Cells with over ``HOT`` times the mean (a hot group of equal texts) are cut again by row into parts of about the
mean, so no window has more than ``HOT`` means of rows and there are fewer than two parts a cell on average.

Defined results: a null text is empty (size 1, crc 0); repeated rows are rows of their own; fewer rows than
shards leave shards empty; texts of any length are hashed whole and not shuffled; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, with_uid

SHARDS, NODES = 16, 256
CELL_BITS = 14
#: A cell with more than so many times the mean rows of a cell, and more than HOT_ROWS, is hot.
HOT, HOT_ROWS = 4, 1000


def ring(shards: int, nodes: int = NODES) -> tuple[list[int], list[int]]:
    """Sorted places of all virtual nodes (64 bits) and their shards."""
    at = sorted((int.from_bytes(blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(nodes))
    return [p for p, _ in at], [s for _, s in at]


def walk(cells: list[tuple[int, int, int]], capacity: list[int], nodes: int = NODES) -> list[tuple[int, int, int, int, int, int]]:
    """Deals cells (cell, sub, rows) clockwise: (cell, sub, first rank, end rank, shard, slot of the first)."""
    places, owners = ring(len(capacity), nodes)
    load, out = [0] * len(capacity), []
    for cell, sub, rows in sorted(cells):
        i = bisect_left(places, (cell << (64 - CELL_BITS)) + (1 << (63 - CELL_BITS)))
        done = 0
        while done < rows:
            shard = owners[i % len(owners)]
            if (take := min(rows - done, capacity[shard] - load[shard])) > 0:
                out.append((cell, sub, done, done + take, shard, load[shard]))
                load[shard] += take
                done += take
            i += 1
    return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """With slack 0, counts that are one apart at most and add up to all rows."""
    if slack > 0:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of ``docs``; slots run from 0 in each shard."""
    text = F.coalesce("text", F.lit(""))
    base = with_uid(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
    ))
    base = materialize(base.withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int")))
    per = {r["cell"]: r["count"] for r in base.groupBy("cell").count().collect()}  # 2 ** CELL_BITS rows at most
    total = sum(per.values())
    mean = max(HOT_ROWS / HOT, total / (1 << CELL_BITS))
    hot = {c: -(-n // int(mean)) for c, n in per.items() if n > HOT * mean}  # fewer than cells / HOT, with fewer parts than cells
    cells = [(c, 0, n) for c, n in per.items() if c not in hot]
    if hot:
        parts = F.broadcast(docs.sparkSession.createDataFrame(list(hot.items()), "cell int, parts int"))
        base = base.join(parts, "cell", "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        cells += [tuple(r) for r in base.join(parts, "cell", "left_semi").groupBy("cell", "sub").count().collect()]
    else:
        base = base.withColumn("sub", F.lit(0))
    pieces = walk(cells, capacities(total, shards, slack), nodes)
    schema = T.StructType([T.StructField(c, T.IntegerType() if c in ("cell", "sub", "shard") else T.LongType()) for c in ("cell", "sub", "lo", "hi", "shard", "slot0")])
    dealt = F.broadcast(docs.sparkSession.createDataFrame(pieces, schema))  # a row for each cell, and for each cut by a full shard
    rank = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("h", "uid")) - 1
    ranked = base.withColumn("rank", rank.cast("long"))
    met = ranked.join(dealt, ["cell", "sub"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return digest(shard(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(dealt: DataFrame) -> DataFrame:
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
