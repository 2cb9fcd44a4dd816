"""Exact removal of long repeated passages, by a depth-limited radix order of all suffixes.

A window is ``depth`` consecutive bytes of a document; it is repeated if the same bytes start anywhere else.
Suffixes are ordered only through ``depth`` bytes, digit by digit; a suffix alone in its group after some digit
leaves the order, and groups that are still together after the last digit are exactly the repeated windows.

The order of digits doesn't change which windows end in one group, so the first digit is chosen where it
shrinks the work most: each window's own minimizer, the leftmost of its ``digit``-byte blocks with the least
hash. Neighbouring windows share it, so the first pass moves one row for each minimizer and not one for each
byte (density about 2 / (depth - digit + 2)). Then

1. first digit: minimizers are counted by hash; windows whose minimizer occurs once leave the order;
2. all windows of a minimizer lie in one extent of the text; if two occurrences have equal extents, all their
   windows are repeated at once, and one member stands for them in the last pass;
3. last digits: where one minimizer has several extents, the windows inside them are ordered by the remaining
   digits of 64 bytes, groups of one leave after each digit, and the groups of two and more that are left are
   the repeated windows.

A minimizer with more than ``GROUP`` extents does step 3 as an aggregation over window hashes, so no group is
held by one task. Steps 1 and 2 count the extents of very frequent minimizers in parts.

Digits are compared by 64-bit polynomial hashes within groups that agreed so far; a false match would need the
minimizer's and the digit's hashes to collide for the same two places.

The same order is run over words ([^\\x20\\x09-\\x0D]+, as they are) through ``word_depth`` tokens: passages of that
many words are often under ``depth`` bytes. It removes nothing; it counts each document's repeated words.

Defined results: a null text is empty; texts of any length are hashed in parts; texts shorter than ``depth`` are never touched and removed bytes are
judged on the input; repeated rows and doc_ids are separate documents; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat_bytes, materialize, pieces, small_batches, with_uid

DEPTH, DIGIT = 400, 128
#: Depth and first digit of the order over words.
WORD_DEPTH, WORD_DIGIT = 50, 16
#: Extents of one minimizer that a task compares by itself.
GROUP = 8192
#: Minimizers with ``SEEN`` extents or more in one text of ``SAMPLE`` are counted in ``PARTS``; the most frequent
#: ``HOT_KEYS`` of them, which bounds what is broadcast. The sample decides where rows are counted and compared, and
#: nothing about the result.
SAMPLE, SEEN, PARTS, HOT_KEYS = 64, 16, 64, 50_000
#: Symbols hashed at a time; positions that overlap the next part are hashed twice.
PART = 1 << 17
#: Documents whose spans and extents are held at a time.
SLICE = 256
#: Bytes of extents that a task compares at a time, unless one group alone has more.
HOLD = 1 << 20

_rng = np.random.default_rng(20240229)
CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2 ** 64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes of any range of bytes or of other symbols' codes, modulo 2 ** 64."""

    up = down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Hasher.up) < n:
            Hasher.up, Hasher.down = _powers(BASE, n + 1024), _powers(INVERSE, n + 1024)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((CODE[data] if data.dtype == np.uint8 else data) * Hasher.up[: n - 1], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        return (self.sums[width:] - self.sums[:-width]) * Hasher.down[: len(self.sums) - width]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Hasher.down[start]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word of the rows, and the rows' n + 1 borders in words; a word ends with its row."""
    inside = ~IS_SPACE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    border = bounds[1:-1]
    border = border[(border > 0) & (border < len(data))]
    head[border], tail[border - 1] = inside[border], inside[border - 1]
    first, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    codes, at = np.zeros(len(first), np.uint64), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(end, first[at] + PART, "right")))
        size = end[at:to] - first[at:to]
        begin = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(begin, size)
        if len(Hasher.up) <= size.max():
            Hasher.up, Hasher.down = _powers(BASE, int(size.max()) + 1024), _powers(INVERSE, int(size.max()) + 1024)
        sums = np.add.reduceat(CODE[data[np.repeat(first[at:to], size) + place]] * Hasher.up[place], begin)
        codes[at:to] = mix(sums + mix(size.astype(np.uint64)))
        at = to
    return codes, np.searchsorted(first, bounds)


def symbols(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes or word codes of the texts, one after another, and the n + 1 borders of the rows."""
    data, bounds = flat_bytes(column)
    return word_codes(data, bounds) if words else (data, bounds)


def minimizers(data: np.ndarray, bounds: np.ndarray, depth: int, digit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per part of the text: (row, minimizer hash, extent hash, first window, minimizer's offset in it, windows).

    ``data`` holds the rows' bytes (or word codes) one after another, ``bounds`` their n + 1 borders; windows across a border
    take no part. An extent is also cut where a part ends, which costs work in the last pass, never a match.
    """
    span, low = depth - digit + 1, np.uint64((1 << 20) - 1)
    for begin in range(0, len(data) - depth + 1, PART):
        part = data[begin : begin + PART + depth - 1]
        n = len(part) - depth + 1
        valid = np.ones(n, bool)
        for border in bounds[np.searchsorted(bounds, begin, "right") : np.searchsorted(bounds, begin + len(part))] - begin:
            valid[max(0, border - depth + 1) : border] = False
        windows = np.flatnonzero(valid)
        if not len(windows):
            continue
        h = Hasher(part)
        first_digit = h.windows(digit)
        # The place in the low bits makes ties go to the leftmost; sliding minimum over span values by doubling.
        least, have = (mix(first_digit) & ~low) | np.arange(len(first_digit), dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & low).astype(np.int64)[windows]
        new = np.flatnonzero((place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
        head, tail = np.concatenate([[0], new]), np.concatenate([new, [len(windows)]]) - 1
        first, last, place = windows[head], windows[tail], place[head]
        key, off, count = first_digit[place], place - first, last - first + 1
        extent = mix(h.ranges(first, last + depth) + mix(key + (off * 1024 + count).astype(np.uint64)))
        row = np.searchsorted(bounds, first + begin, "right") - 1
        yield row, key.view(np.int64), extent.view(np.int64), first + begin - bounds[row], off, count


def _batches(words: bool, depth: int, digit: int, batches: Iterator[pa.RecordBatch]):
    for b in pieces(batches):
        data, bounds = symbols(b.column("text"), words)
        parts = list(minimizers(data, bounds, depth, digit))
        if parts:
            yield b, [np.concatenate(x) for x in zip(*parts)]


def _count(words: bool, depth: int, digit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, key, extent, *_rest) in _batches(words, depth, digit, batches):
            extent, at, n = np.unique(extent, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(extent), pa.array(n)], names=["key", "extent", "n"])

    return run


def _locate(words: bool, depth: int, digit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (row, key, extent, first, off, count) in _batches(words, depth, digit, batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("uid").take(pa.array(row)), pa.array(key), pa.array(extent), pa.array(first), pa.array(off.astype(np.int16)), pa.array(count.astype(np.int16))],
                names=["uid", "key", "extent", "first", "off", "windows"],
            )

    return run


def _cut(words: bool, depth: int):
    """Bytes (or word codes, as bytes) of the extents listed in ``want``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, SLICE):
            data, bounds = symbols(b.column("text"), words)
            want = b.column("want")
            row = np.repeat(np.arange(len(want)), want.value_lengths().to_numpy(zero_copy_only=False))
            one = want.flatten()
            start = bounds[row] + one.field("first").to_numpy()
            size = one.field("windows").to_numpy().astype(np.int64) + depth - 1
            texts = [data[i:j].tobytes() for i, j in zip(start.tolist(), (start + size).tolist())]
            names = ["key", "extent", "n", "classes", "first", "off", "windows"]
            yield pa.RecordBatch.from_arrays(
                [b.column("uid").take(pa.array(row)), *[one.field(x) for x in names], pa.array(texts, pa.binary())], names=["uid", *names, "bytes"]
            )

    return run


def repeated_windows(key: np.ndarray, off: np.ndarray, count: np.ndarray, texts: list[bytes], depth: int, digit: int = 64, kind: type = np.uint8) -> np.ndarray:
    """For extents of any minimizers: a flag for each window, extent by extent, true if another extent has its bytes.

    Radix passes, most significant digit first, over the windows that share a minimizer and its offset; a
    window alone in its group leaves.
    """
    data = np.frombuffer(b"".join(texts), kind)
    base = np.concatenate([[0], np.cumsum([len(t) // data.itemsize for t in texts])])[:-1]
    which = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    start = base[which] + step
    alive = np.arange(len(which))
    group = mix(key.view(np.uint64)[which] + mix((off[which] - step + 1).astype(np.uint64)))
    h = Hasher(data)
    done = -digit
    while len(alive):
        _, group, size = np.unique(group, return_inverse=True, return_counts=True)
        keep = size[group] > 1
        alive, group = alive[keep], group[keep]
        done += digit
        if done >= depth:
            break
        at = start[alive] + done
        group = mix(h.ranges(at, at + min(digit, depth - done)) + mix(group.astype(np.uint64)))
    out = np.zeros(len(which), bool)
    out[alive] = True
    return out


def runs_of(flags: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(extent, first, last) of the runs of flagged windows; a run ends with its extent."""
    at = np.flatnonzero(flags)
    which = np.repeat(np.arange(len(count)), count)[at]
    new = np.flatnonzero((at[1:] != at[:-1] + 1) | (which[1:] != which[:-1])) + 1
    head, tail = np.concatenate([[0], new])[: max(1, len(at))].astype(int), np.concatenate([new, [len(at)]]).astype(int) - 1
    if not len(at):
        return which, at, at
    base = (np.cumsum(count) - count)[which[head]]
    return which[head], at[head] - base, at[tail] - base


def _compare(words: bool, depth: int):
    """Whole groups of one minimizer at a time; rows come sorted by key."""
    names = ["uid", "key", "n", "first", "off", "windows"]

    def spans(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        uid, key, n, first, off, count = (t.column(x).to_numpy() for x in names)
        count = count.astype(np.int64)
        flags = repeated_windows(key, off.astype(np.int64), count, t.column("bytes").to_pylist(), depth, *((8, np.uint64) if words else ()))
        which, lo, hi = runs_of(flags, count)
        one = n[which] == 1  # others are removed whole
        which, lo, hi = which[one], lo[one], hi[one]
        if len(which):
            yield pa.RecordBatch.from_arrays([pa.array(uid[which]), pa.array(first[which] + lo), pa.array(first[which] + hi + depth)], names=["uid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.nbytes for x in held) < HOLD:
                continue
            key = b.column("key").to_numpy()
            if held[0].column("key")[0].as_py() != key[-1]:
                whole, held = _split(held, key[-1])
                yield from spans(whole)
        if held:
            yield from spans(held)

    return run


def _split(held: list[pa.RecordBatch], key: int) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    whole, rest = [], []
    for b in held:
        cut = int((b.column("key").to_numpy() != key).sum())
        whole.append(b.slice(0, cut))
        rest.append(b.slice(cut))
    return [x for x in whole if x.num_rows], [x for x in rest if x.num_rows]


def _hashes(words: bool, depth: int):
    """A row for each window of the extents, for groups too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, key, n, first, off, count = (b.column(x).to_numpy() for x in ("uid", "key", "n", "first", "off", "windows"))
            for k, text in enumerate(b.column("bytes").to_pylist()):
                wide = mix(Hasher(np.frombuffer(text, np.uint64 if words else np.uint8)).windows(depth)).view(np.int64)
                m = int(count[k])
                at = np.arange(m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, key[k])), pa.array(off[k] - at), pa.array(wide), pa.array(np.full(m, uid[k])), pa.array(np.full(m, n[k])), pa.array(first[k] + at)],
                    names=["key", "off", "window", "uid", "n", "start"],
                )

    return run


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, SLICE):
        data, bounds = flat_bytes(b.column("text"))
        starts, ends, kept, n_words, n_repeated = [], [], [], [], []
        for k, spans in enumerate(b.column("spans").to_pylist()):
            spans = spans or ()
            runs = _merged([(x["start"], x["end"]) for x in spans if not x["words"]])
            text = data[bounds[k] : bounds[k + 1]].tobytes()
            at, parts = 0, []
            for i, j in runs:
                parts.append(text[at:i])
                at = j
            kept.append(b"".join([*parts, text[at:]]))
            starts.append([i for i, _ in runs])
            ends.append([j for _, j in runs])
            n_words.append(len(text.split()))
            n_repeated.append(sum(j - i for i, j in _merged([(x["start"], x["end"]) for x in spans if x["words"]])))
        long = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("uid"), b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(starts, long), pa.array(ends, long), pa.array(kept, pa.large_binary()).cast(pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_repeated, pa.int64())],
            names=["uid", "doc_id", "n_bytes", "starts", "ends", "kept", "n_words", "n_repeated_words"],
        )


def _spans(base: DataFrame, dealt: DataFrame, words: bool, depth: int, digit: int, group: int) -> DataFrame:
    """(uid, start, end) of windows, or runs of them, that start anywhere else too; in bytes or in words."""
    texts = base.select("uid", "text")
    found = "key long, extent long, n long"
    some = texts.where(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).mapInArrow(_count(words, depth, digit), found)
    some = some.select("key", "extent").distinct().groupBy("key").agg(F.count("*").alias("seen")).where(F.col("seen") >= SEEN)
    with small_batches(base.sparkSession):
        hot = materialize(some.orderBy(F.desc("seen"), "key").limit(HOT_KEYS))

    counts = texts.mapInArrow(_count(words, depth, digit), found).join(F.broadcast(hot), "key", "left")
    counts = counts.withColumn("part", F.when(F.isnull("seen"), 0).otherwise(F.pmod("extent", F.lit(PARTS)))).repartition("key", "part")
    counts = counts.groupBy("key", "part", "extent").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"))
    per = Window.partitionBy("key", "part")
    shared = counts.withColumn("all", F.sum("n").over(per)).withColumn("classes", F.count("*").over(per))
    # A minimizer that the sample saw has several extents for sure; how many only decides who compares them.
    shared = shared.where("all > 1 or seen is not null").select("key", "extent", "n", F.coalesce(F.col("seen") * SAMPLE, "classes").alias("classes"))
    places = texts.mapInArrow(_locate(words, depth, digit), "uid long, key long, extent long, first long, off short, windows short")
    with small_batches(base.sparkSession):
        hits = materialize(places.join(shared, ["key", "extent"]))

    one = F.min(F.struct("uid", "first", "off", "windows")).alias("x")
    want = hits.where("classes > 1").groupBy("key", "extent", "n", "classes").agg(one)
    want = want.groupBy("x.uid").agg(F.collect_list(F.struct("key", "extent", "n", "classes", "x.first", "x.off", "x.windows")).alias("want"))
    # The same columns as in the last join, so that the texts are shuffled once for all.
    cuts = dealt.join(want, "uid").select("uid", "doc_id", "text", "want").mapInArrow(
        _cut(words, depth), "uid long, key long, extent long, n long, classes long, first long, off short, windows short, bytes binary"
    )
    few = cuts.where(F.col("classes") <= group).repartition("key").sortWithinPartitions("key", "extent")
    spans = few.mapInArrow(_compare(words, depth), "uid long, start long, end long")
    if not hits.where(F.col("classes") > group).isEmpty():
        rows = cuts.where(F.col("classes") > group).mapInArrow(_hashes(words, depth), "key long, off long, window long, uid long, n long, start long")
        twice = rows.groupBy("key", "off", "window").count().where("count > 1")
        many = rows.where("n = 1").join(twice, ["key", "off", "window"], "left_semi")
        spans = spans.union(many.selectExpr("uid", "start", f"start + {depth} as end"))
    return spans.union(hits.where("n > 1").selectExpr("uid", "first as start", f"first + windows - 1 + {depth} as end"))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, group: int = GROUP, word_depth: int = WORD_DEPTH, word_digit: int = WORD_DIGIT) -> DataFrame:
    """Per row of ``docs``: uid, doc_id, n_bytes, starts and ends of the removed byte runs, kept (the other bytes),
    n_words and n_repeated_words (words inside any ``word_depth`` words in a row that start anywhere else too).

    ``docs`` is scanned more than once and must yield the same rows in the same partitions each time, as files do.
    """
    base = with_uid(docs.select("doc_id", "text"))
    dealt = base.repartition("uid")
    spans = _spans(base, dealt, False, depth, digit, group).withColumn("words", F.lit(False))
    spans = spans.union(_spans(base, dealt, True, word_depth, word_digit, group).withColumn("words", F.lit(True)))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end", "words")).alias("spans"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return dealt.join(spans, "uid", "left").mapInArrow(
        _remove, f"uid long, doc_id {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary, n_words long, n_repeated_words long"
    )


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of all documents. The session keeps Arrow batches of 1,024 rows from here on: the result is computed
    when it is read, and each batch of whole texts is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated_words",
    )
