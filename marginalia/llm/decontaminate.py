"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of ``window`` consecutive words of the benchmark items (a shorter item is one
pattern of its own length). For each pattern length m a shift table over blocks of two words tells how far the
search can skip; where the shift is zero, the suffix block and the first word select test patterns and a direct
comparison of all words confirms an occurrence.

The items are read in blocks of bounded size (``block_bytes`` of text); each block is broadcast on its own and
a task holds one block's tables at a time, so the benchmark may be of any size. With more than one block a task
gathers documents up to ``HOLD`` bytes and builds each block's tables once for all of them.

Defined results: null or empty texts have no words, are never hit and count as clean; texts of any length are
searched whole; an item without words matches nothing; items with a null item_id hit words but are not listed; repeated items count once, repeated
documents each; an empty benchmark leaves every document clean; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, pieces, text_bytes

WINDOW = 13
BLOCK_BYTES = 2_000_000
#: Bytes of documents for which a task builds the tables of each of several blocks.
HOLD = 32_000_000


def words_of(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


class WuManber:
    """Search for word patterns: windows of the items' words, grouped by their length."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.words: list[list[bytes]] = []
        self.ids: list[str | None] = []
        lengths: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k, m = len(self.words), min(window, len(words))
            self.words.append(words)
            self.ids.append(item_id)
            lengths[m] += [(k, i) for i in range(len(words) - m + 1)]
        self.tables = [self._table(m, patterns) for m, patterns in sorted(lengths.items())]

    def _table(self, m: int, patterns: list[tuple[int, int]]):
        b = min(2, m)
        shift: dict[tuple[bytes, ...], int] = {}
        bucket: dict[tuple[bytes, ...], dict[bytes, list[tuple[int, int]]]] = {}
        for k, at in patterns:
            words = self.words[k]
            for end in range(b, m + 1):
                block = tuple(words[at + end - b : at + end])
                if m - end < shift.get(block, m):
                    shift[block] = m - end
            bucket.setdefault(block, {}).setdefault(words[at], []).append((k, at))
        return m, b, shift, bucket

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(item number, first word, end) of every occurrence."""
        n = len(text)
        for m, b, shift, bucket in self.tables:
            far, end = m - b + 1, m
            get = shift.get
            while end <= n:
                block = (text[end - 2], text[end - 1]) if b == 2 else (text[end - 1],)
                step = get(block, far)
                if step:
                    end += step
                    continue
                start = end - m
                for k, at in bucket[block].get(text[start], ()):
                    if self.words[k][at : at + m] == text[start:end]:
                        yield k, start, end
                end += 1


def broadcast_items(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark's items in broadcast blocks of about ``block_bytes``; the driver holds one block at a time."""
    sc = benchmark.sparkSession.sparkContext
    parts, block, size = [], [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").where(F.length("text") > 0).toLocalIterator():
        data = text.encode()
        block.append((item_id, data))
        size += len(data)
        if size >= block_bytes:
            parts.append(sc.broadcast(block))
            block, size = [], 0
    return parts + ([sc.broadcast(block)] if block else [])


def gathered(batches: Iterator[pa.RecordBatch], parts: list) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, or, if there are several blocks of items, batches of about ``HOLD`` bytes."""
    if len(parts) < 2:
        yield from pieces(batches)
        return
    held: list[pa.RecordBatch] = []
    for b in pieces(batches):
        held.append(b)
        if sum(x.nbytes for x in held) >= HOLD:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def scan(texts: list[bytes], parts: list, window: int, held: dict) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text its number of words, the merged word runs that are hit and the ids of the items found.

    ``held`` keeps the tables of the block used last from one batch to the next.
    """
    sizes = [0 for _ in texts]
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for k, part in enumerate(parts):
        if held.get("k") != k:
            held.clear()
            held.update(k=k, tables=WuManber(part.value, window))
        tables = held["tables"]
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            for item, start, end in tables.search(words):
                runs[i].append((start, end))
                if tables.ids[item] is not None:
                    items[i].add(tables.ids[item])
    if not parts:
        sizes = [len(words_of(x)) for x in texts]
    for size, found, ids in zip(sizes, runs, items):
        merged: list[tuple[int, int]] = []
        for start, end in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        yield size, merged, ids


def is_contaminated(n_words: int, n_hit: int, share: int = 20) -> bool:
    return n_hit > 0 and share * n_hit >= n_words


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids found), runs (hit word runs), contaminated."""
    parts = broadcast_items(benchmark, block_bytes)
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in gathered(batches, parts):
            n_words, n_hit, items, runs, bad = [], [], [], [], []
            for size, merged, ids in scan(text_bytes(b.column("text")), parts, window, held):
                hit = sum(end - start for start, end in merged)
                n_words.append(size)
                n_hit.append(hit)
                items.append(sorted(ids))
                runs.append([{"start": s, "end": e} for s, e in merged])
                bad.append(is_contaminated(size, hit))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(runs, run_type), pa.array(bad, pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "items", "runs", "contaminated"],
            )

    return base.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, runs array<struct<start:long,end:long>>, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold any window of an item, so that none of the benchmark is left.

    With ``share`` only those go whose hit words are at least one in ``share`` of their words. No column changes
    and nothing is shuffled.
    """
    parts = broadcast_items(benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in gathered(batches, parts):
            found = scan(text_bytes(b.column("text")), parts, window, held)
            yield b.filter(pa.array([not (is_contaminated(n, sum(e - s for s, e in merged), share) if share else merged) for n, merged, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP4_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), pat AS (
  SELECT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), win AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)
), occ AS (
  SELECT DISTINCT win.r, win.i, win.m, pat.item_id FROM win JOIN pat ON win.m = pat.m AND win.p = pat.p
), hit AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM occ) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(doc.w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
