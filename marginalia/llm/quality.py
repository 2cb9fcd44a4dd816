"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are hashed n-grams of its words (n = 1, 2), of its words' shapes (n = 1, 2: letter case,
digits and punctuation runs, so that unseen words count too) and of marks for repeated n-grams (a word that
repeats the one before it, a word pair or a line seen earlier in the text). A feature's value is the root of
its share of the text. Training reads a bounded sample of labelled texts in a fixed order (FTRL-proximal,
per-coordinate rates, L1 and L2); scoring is one sparse dot product per text.

Defined results: null or empty texts have no feature but the constant and score the sigmoid of its weight;
repeated rows score alike; without labels of both classes the weights stay 0 and scores 0.5; other columns are
not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, pieces, text_bytes
from .tokens import Remember, is_held_out, labelled_sample

#: Labelled documents that the model is fitted on, at most.
MAX_TRAIN = 6_000
BITS = 18
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
THRESHOLD = 0.7
_MASK = np.uint32((1 << BITS) - 1)
_SHAPE = [(re.compile(p), r) for p, r in ((rb"[a-z\x80-\xff]+", b"a"), (rb"[A-Z]{2,}", b"AA"), (rb"[0-9]+", b"0"), (rb"([^A-Za-z0-9])\1+", rb"\1\1"))]


def shape(word: bytes) -> bytes:
    for pattern, to in _SHAPE:
        word = pattern.sub(to, word)
    return word[:12]


def word_code(word: bytes) -> int:
    """Hash of the lower-cased word in the high half, of its shape in the low half."""
    return crc32(word.translate(LOWER)) << 32 | crc32(shape(word), 7)


def _spread(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint32(salt)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)


def features(data: bytes, memory: Remember) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values of a text."""
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    code = np.fromiter(map(memory.__getitem__, words), np.uint64, n)
    word, form = (code >> np.uint64(32)).astype(np.uint32), code.astype(np.uint32)
    parts = [_spread(word, 1), _spread(form, 2)]
    marks = []
    if n > 1:
        pair = word[:-1] * np.uint32(0x01000193) ^ word[1:]
        parts += [_spread(pair, 3), _spread(form[:-1] * np.uint32(0x01000193) ^ form[1:], 4)]
        marks.append((11, int((word[1:] == word[:-1]).sum()), n - 1))
        marks.append((12, n - 1 - len(np.unique(pair)), n - 1))
    marks.append((13, n - len(np.unique(word)), n))
    lines = data.split(b"\n")
    marks.append((14, len(lines) - len(set(lines)), len(lines)))
    at, count = np.unique(np.concatenate(parts), return_counts=True)
    values = np.sqrt(count / n)
    index, value = [at.astype(np.int64)], [values]
    for salt, some, of in marks:
        # The share and whether it passes each of a few levels.
        share = some / of
        for k, level in enumerate((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)):
            if share > level:
                index.append(_spread(np.array([salt * 64 + k], np.uint32), 5).astype(np.int64))
                value.append(np.ones(1))
    length = min(15, int(np.log2(n)))
    index += [_spread(np.array([length], np.uint32), 6).astype(np.int64), np.zeros(1, np.int64)]
    value += [np.full(1, 0.5), np.ones(1)]
    return np.concatenate(index), np.concatenate(value).astype(np.float32)


class Ftrl:
    """FTRL-proximal with per-coordinate learning rates (McMahan et al. 2013)."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        np.add.at(self.z, at, g - rate * w)
        np.add.at(self.n, at, g * g)


def fit_texts(texts: list[bytes], labels: list[int]) -> np.ndarray:
    memory, model = Remember(word_code), Ftrl()
    rows = [features(t, memory) for t in texts]
    if len(set(labels)) == 2:
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                model.update(*rows[i], labels[i])
    return model.weights(np.arange(1 << BITS)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", most: int = MAX_TRAIN) -> np.ndarray:
    """Weights from a bounded sample; one task trains, the driver gets 2 ** BITS floats."""
    sample = labelled_sample(docs, labels, label, keep, most).withColumn("one", F.lit(1))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "text"], kind="stable")
        return pd.DataFrame({"w": [fit_texts([t.encode() for t in rows["text"]], rows["y"].tolist()).tobytes()]})

    got = sample.groupBy("one").applyInPandas(run, "w binary").first()
    return np.frombuffer(got["w"], np.float32) if got else np.zeros(1 << BITS, np.float32)


def text_score(data: bytes, weights: np.ndarray, memory: Remember) -> float:
    at, x = features(data, memory)
    return float(1 / (1 + np.exp(-np.clip(weights[at] @ x, -35, 35))))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memory = shared.value, Remember(word_code)
        for b in pieces(batches):
            s = [text_score(x, w, memory) for x in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return base.mapInArrow(run, f"doc_id {kind}, score double")


def drop_rejected(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score under the threshold; no column changes and nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, memory = shared.value, Remember(word_code)
        for b in pieces(batches):
            yield b.filter(pa.array([text_score(x, w, memory) >= threshold for x in text_bytes(b.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = train(docs, labels, ~is_held_out(4, 2))
    return score(docs, weights).select("doc_id", is_held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
