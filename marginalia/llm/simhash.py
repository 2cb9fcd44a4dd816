"""SimHash near-duplicate classes by multi-index hashing.

Fingerprints are cut into segments. By the pigeonhole principle two fingerprints within ``radius`` bits agree
in some segment up to that segment's small radius, where the radii r_i satisfy sum(r_i + 1) = radius + 1. Each
fingerprint is tabled under its exact segment values and probes the Hamming ball of that radius around them;
what a probe fetches is verified over all 64 bits.

Defined results: a null text counts as empty and has fingerprint zero, which links like any other; repeated
rows and equal texts share a class; a null doc_id is passed over when the smallest id of a class is taken
(null if a class has no other); texts of any length are read whole; an empty table gives an empty result; columns other than doc_id and text are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, materialize, pieces, text_bytes, with_uid
from .graph import connected_components, forest, join_hubs

#: Segment (width, radius) for radius 4, by the number of distinct fingerprints up to which they are used.
PLANS = ((200_000_000, ((22, 1), (22, 1), (20, 0))), (1 << 62, ((32, 2), (32, 1))))
#: Table entries that one block of a bucket holds; larger buckets are dealt over several blocks.
BLOCK = 4096
#: Pairs verified at a time.
PAIRS = 1 << 21


def fingerprint(data: bytes, width: int = 4) -> int:
    """Fingerprint of UTF-8 bytes: majority of the XXH64 (seed 42) bits over the word shingles."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(text, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(text[i:j], 42) for i, j in zip((ends - size)[: 1 - width].tolist(), ends[width - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(uid, doc_id, fp) for each row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.array([fingerprint(x, width) for x in text_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(fps)], names=["uid", "doc_id", "fp"])

    base = with_uid(docs.select("doc_id", "text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"uid long, doc_id {kind}, fp long")


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        last = None
        for batch in batches:
            key, block, fp, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "fp", "own"))
            if not len(key):
                continue
            if (key[0], block[0]) != last:
                held = held[:0]
            n = len(held)
            every, entry = np.concatenate([held, fp]), np.concatenate([np.ones(n, bool), own.astype(bool)])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            group = np.concatenate([np.zeros(n, np.int64), np.cumsum(new) - 1])
            table = every[entry]
            have = np.bincount(group[entry], minlength=group[-1] + 1)
            first = np.cumsum(have) - have
            count = np.where(entry, np.cumsum(entry) - 1 - first[group], have[group])
            count[:n] = 0
            last = (key[-1], block[-1])
            held = every[entry & (group == group[-1])]
            rows = np.flatnonzero(count)
            total = np.cumsum(count[rows])
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
                part, many = rows[at:to], count[rows[at:to]]
                i = np.repeat(part, many)
                j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[group[i]]
                differ = every[i] ^ table[j]
                ok = (differ != 0) & (np.bitwise_count(differ.view(np.uint64)) <= radius)
                a, b = forest(every[i[ok]], table[j[ok]])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                at = to

    return run


def links(distinct: DataFrame, radius: int = 4, plan: tuple | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the same fingerprints as all links within ``radius`` bits do.

    ``distinct`` holds each fingerprint once as fp. Per verified chunk only a spanning forest is sent on, so
    the output is linear in the probes even where thousands of fingerprints lie within reach of each other.
    A bucket with more than ``block`` entries is dealt over blocks, each of which meets every probe.
    """
    plan = plan or next(p for most, p in PLANS if distinct.count() <= most)
    if sum(r + 1 for _, r in plan) != radius + 1 or sum(w for w, _ in plan) != 64:
        raise ValueError("segment widths must add up to 64 and radii + 1 to radius + 1")
    cases, shift = [], 0
    for k, (width, r) in enumerate(plan):
        for bits in range(r + 1):
            cases += [(k, shift, width, sum(1 << i for i in flips)) for flips in combinations(range(width), bits)]
        shift += width
    probe = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit((1 << w) - 1).cast("long").alias("w"), F.lit(m).cast("long").alias("m")) for k, s, w, m in cases])
    rows = distinct.select("fp", F.explode(probe).alias("c")).selectExpr(
        "(((shiftrightunsigned(fp, c.s) & c.w) ^ c.m) | shiftleft(cast(c.k as bigint), 40)) as key", "fp", "c.m = 0 as own"
    )
    hot = materialize(rows.where("own").groupBy("key").count().where(F.col("count") > block))
    if hot.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(float(block))).cast("int")
        home = F.pmod(F.xxhash64("fp"), F.col("parts"))
        rows = rows.join(hot, "key", "left").withColumn("parts", parts).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("own", F.col("own") & (home == F.col("block"))).select("key", "fp", "own", "block")
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("own"))
    return dealt.mapInArrow(_link(radius), "a long, b long")


def classes(prints: DataFrame, radius: int = 4, plan: tuple | None = None, block: int = BLOCK) -> DataFrame:
    """(fp, component_id): the smallest doc_id that each fingerprint reaches over links of ``radius`` bits."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(links(distinct.select("fp"), radius, plan, block), "a", "b")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialize(linked.select("fp", "root", "least_id"))
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    return join_hubs(linked.select("fp", "root"), least, "root", linked.count()).select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, plan: tuple | None = None, block: int = BLOCK) -> DataFrame:
    """(uid, doc_id, fp, component_id, root) for each row of ``docs``."""
    prints = materialize(fingerprints(docs, width))
    return prints.join(classes(prints, radius, plan, block), "fp").select("uid", "doc_id", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each class: the row with the smallest doc_id (null last), then the first."""
    found = near_duplicates(docs, radius)
    kept = found.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "uid")).alias("k")).select(F.col("k.uid").alias("uid"))
    packed = with_uid(docs.select(F.struct("*").alias("row")))
    return packed.join(kept, "uid", "left_semi").select("row.*")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
