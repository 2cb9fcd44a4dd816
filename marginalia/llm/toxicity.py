"""Toxicity by maximum-scoring segments.

Fit: token counts of toxic and clean labelled documents give each token a log-odds score. Two Dirichlet priors
smooth it: pseudo-counts in proportion to the token's share of the whole corpus, and pseudo-counts that follow
the class shares of the token's stem (its first five bytes), so that rare forms borrow from their stem. Tokens
are hashed to a fixed number of buckets, which bounds the model at any corpus size. A constant drift makes the
expected score of clean text negative.

Score: one linear scan per text (Ruzzo and Tompa) finds every maximal-scoring segment. Karlin-Altschul
statistics calibrate them: with lambda from the score distribution of clean text, a segment of score S in n
tokens has the normalised score lambda * S - ln(K n), whose exceedances follow the extreme-value law. K comes
from the best segments of the clean training texts: the mean of lambda * S - ln n of Gumbel's law is ln K plus
Euler's constant. A document's evidence is the best sum statistic over its r best segments, T_r - ln r!; a monotone logistic
curve, fitted to all labelled training documents, turns it into a probability.

Defined results: null or empty texts have no segment and get the model's score for no evidence; texts of any
length are scanned whole, once; repeated rows score alike; without usable labels every score is 0.5; other columns are not looked at.
"""

from __future__ import annotations

import math

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, pieces, text_bytes
from .tokens import Remember, is_held_out, labelled_sample

#: Labelled documents that the model is fitted on, at most.
MAX_TRAIN = 20_000
#: Buckets of words, stems and corpus shares; bounds of what is collected and broadcast.
WORDS, STEMS, SHARES = 1 << 18, 1 << 14, 1 << 16
STEM_BYTES = 5
#: Pseudo-counts: the whole corpus prior, and the stem's, per token.
CORPUS_PRIOR, STEM_PRIOR = 2_000.0, 4.0
#: Taken off each token's log-odds.
DRIFT = 0.75
#: Bins of document evidence that the logistic curve is fitted on.
BINS, LOW, HIGH = 2048, -40.0, 216.0


def tokens(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


def stem(word: bytes) -> int:
    return crc32(word[:STEM_BYTES]) & (STEMS - 1)


def segments(at: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) over tokens at places ``at`` with gains > 0.

    ``loss[i]`` is the cumulative score of all tokens before place ``at[i]``. Linear time; tokens that lower
    the sum only count through ``loss``.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, cumulative before, cumulative after
    for place, plus, before in zip(at.tolist(), gain.tolist(), loss.tolist()):
        first, left, right = place, before, before + plus
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
        found.append((first, place, left, right))
    return [(first, last, right - left) for first, last, left, right in found]


@dataclass
class Model:
    word: np.ndarray  # token scores by word bucket
    stem: np.ndarray  # for words that were not seen
    lam: float
    k: float
    slope: float = 0.0
    offset: float = 0.0

    def token_score(self, word: bytes) -> float:
        s = self.word[crc32(word) & (WORDS - 1)]
        return float(self.stem[stem(word)] if np.isnan(s) else s)

    def passages(self, data: bytes, memory: Remember) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(data)
        if not words:
            return 0, []
        score = np.fromiter(map(memory.__getitem__, words), np.float64, len(words))
        again = np.flatnonzero(score[1:] == score[:-1]) + 1  # a token said again at once adds no evidence
        again = again[[words[i] == words[i - 1] for i in again.tolist()]]
        score[again] = -DRIFT
        at = np.flatnonzero(score > 0)
        if not len(at):
            return len(words), []
        total = np.cumsum(score)
        return len(words), segments(at, score[at], total[at] - score[at])

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        if not found:
            return LOW
        norm = sorted((self.lam * s - math.log(self.k * n) for _, _, s in found), reverse=True)
        best = total = norm[0]
        for r, x in enumerate(norm[1:], 2):
            if x <= 0:
                break
            total += x
            best = max(best, total - math.lgamma(r + 1))
        return max(best, LOW)

    def significant(self, n: int, found: list[tuple[int, int, float]], level: float = 0.05) -> list[tuple[int, int, float]]:
        """Segments whose expected number in clean text of this length is at most ``level``."""
        return [x for x in found if self.k * n * math.exp(-min(700.0, self.lam * x[2])) <= level]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.offset))))


def corpus_shares(docs: DataFrame) -> np.ndarray:
    """Share of each bucket in all tokens of ``docs``; collected: at most SHARES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SHARES, np.int64)
        memory = Remember(lambda w: crc32(w) & (SHARES - 1))
        for b in pieces(batches):
            for x in text_bytes(b.column("text")):
                words = tokens(x)
                np.add.at(total, np.fromiter(map(memory.__getitem__, words), np.int64, len(words)), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SHARES)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out / max(1.0, out.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts by class: kind 0 word buckets (with the largest stem and corpus bucket of the words there)."""
    count = np.zeros((2, WORDS), np.int64)
    home = np.zeros((2, WORDS), np.int32)
    memory = Remember(lambda w: crc32(w) & (WORDS - 1))
    for b in pieces(batches):
        for x, y in zip(text_bytes(b.column("text")), b.column("y").to_pylist()):
            words = tokens(x)
            bucket = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
            np.add.at(count[y], bucket, 1)
            for w in set(words):
                k = crc32(w) & (WORDS - 1)
                home[0, k], home[1, k] = max(home[0, k], stem(w)), max(home[1, k], k & (SHARES - 1))
    at = np.flatnonzero(count.any(axis=0))
    cols = [at.astype(np.int32), home[0, at], home[1, at], count[0, at], count[1, at]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "stem", "share", "clean", "toxic"])


def karlin_lambda(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1."""
    p = weight / weight.sum()
    if (p * score).sum() >= 0 or score.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * score, 600))).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * score, 600))).sum() < 1 else (low, mid)
    return high


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted, lightly penalised logistic curve, by Newton steps."""
    a = b = 0.0
    scale = 20.0
    z = x / scale
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([(w * (y - p) * z).sum() - 1e-2 * a, (w * (y - p)).sum() - 1e-2 * b])
        v = w * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-2, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, a / scale), b


def fit(docs: DataFrame, train: DataFrame) -> Model:
    """Model from ``train`` (text, y), which is bounded, and token shares of all ``docs``."""
    rows = train.mapInArrow(_count, "bucket int, stem int, share int, clean long, toxic long")
    rows = rows.groupBy("bucket").agg(F.max("stem").alias("stem"), F.max("share").alias("share"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    word, by_stem = np.full(WORDS, np.nan), np.full(STEMS, -DRIFT)
    clean, toxic = rows["clean"].to_numpy(float), rows["toxic"].to_numpy(float)
    if not clean.sum() or not toxic.sum():
        return Model(word, by_stem, 1.0, 1.0)
    share = corpus_shares(docs)[rows["share"].to_numpy()]
    n = clean.sum() + toxic.sum()
    prior = CORPUS_PRIOR * share
    # Rates in each class, scaled to the same total, so that equal shares give equal numbers.
    t, c = toxic / toxic.sum() * n / 2, clean / clean.sum() * n / 2
    weight_t, weight_c = n / 2 / toxic.sum(), n / 2 / clean.sum()
    st = np.bincount(rows["stem"], weights=t, minlength=STEMS)
    sc = np.bincount(rows["stem"], weights=c, minlength=STEMS)
    ps = np.bincount(rows["stem"], weights=prior, minlength=STEMS) + 1
    stem_share = (st + ps * weight_t / 2) / (st + sc + ps * (weight_t + weight_c) / 2)
    stem_share = np.where(st + sc > 0, stem_share, 0.5)
    # A neutral prior in counts has the same weight in both classes after scaling.
    even = max(weight_t, weight_c)
    q = stem_share[rows["stem"].to_numpy()]
    delta = np.log((t + prior * even / 2 + STEM_PRIOR * even * q) / (c + prior * even / 2 + STEM_PRIOR * even * (1 - q)))
    word[rows["bucket"].to_numpy()] = delta - DRIFT
    seen = st + sc > 0
    by_stem[seen] = np.log(stem_share[seen] / (1 - stem_share[seen])) / 2 - DRIFT  # half, as no form of it was seen
    return Model(word, by_stem, karlin_lambda(delta - DRIFT, clean), 0.1)


def _estimate_k(model: Model, train: DataFrame) -> Model:
    """K from the best segment of each clean training text with a token; two sums reach the driver."""
    shared = train.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        memory, n_texts, total = Remember(m.token_score), 0, 0.0
        for b in pieces(batches):
            for x in text_bytes(b.column("text")):
                n, found = m.passages(x, memory)
                if n:
                    n_texts += 1
                    total += m.lam * max((s for _, _, s in found), default=0.0) - math.log(n)
        yield pa.RecordBatch.from_arrays([pa.array([n_texts], pa.int64()), pa.array([total])], names=["n", "total"])

    n, total = train.where("y = 0").mapInArrow(run, "n long, total double").agg(F.sum("n"), F.sum("total")).first()
    if n:
        model.k = math.exp(total / n - float(np.euler_gamma))
    return model


def _calibrate(model: Model, train: DataFrame) -> Model:
    """The curve over evidence, from a histogram of all training documents (at most 2 * BINS rows)."""
    shared = train.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        memory = Remember(m.token_score)
        for b in pieces(batches):
            e = [m.evidence(*m.passages(x, memory)) for x in text_bytes(b.column("text"))]
            bins = np.clip((np.array(e) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("y")], names=["bin", "y"])

    rows = train.mapInArrow(run, "bin int, y int").groupBy("bin", "y").count().toPandas()
    if rows["y"].nunique() == 2:
        x = LOW + (rows["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
        model.slope, model.offset = fit_logistic(x, rows["y"].to_numpy(float), rows["count"].to_numpy(float))
    return model


def train(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", most: int = MAX_TRAIN) -> Model:
    sample = labelled_sample(docs, labels, label, keep, most)
    return _calibrate(_estimate_k(fit(docs, sample), sample), sample)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score, evidence, passages (significant ones: first and last token, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        memory = Remember(m.token_score)
        for b in pieces(batches):
            p, e, found = [], [], []
            for x in text_bytes(b.column("text")):
                n, all_of = m.passages(x, memory)
                e.append(m.evidence(n, all_of))
                p.append(m.probability(e[-1]))
                found.append([dict(zip(("first", "last", "score"), s)) for s in m.significant(n, all_of)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array(e, pa.float64()), pa.array(found, passage)], names=["doc_id", "score", "evidence", "passages"])

    return base.mapInArrow(run, f"doc_id {kind}, score double, evidence double, passages array<struct<first:long,last:long,score:double>>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels, ~is_held_out(5, 0))
    return score(docs, model).select(
        "doc_id", is_held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )
