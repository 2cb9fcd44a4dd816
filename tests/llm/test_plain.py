"""Sharding, quality and toxicity against plain forms of their methods."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from marginalia.llm import quality, sharding, toxicity
from marginalia.llm.tokens import Remember

from .test_operators import frame

SF = "/root/testdata/sf0.001"


# --- sharding ----------------------------------------------------------------------------------------------------


def plain_ring(texts, shards, capacity, nodes=sharding.NODES, bits=sharding.CELL_BITS):
    """Texts in ring order, each to the first virtual node clockwise of its cell's middle whose shard has room."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for v in range(nodes))
    order = sorted(range(len(texts)), key=lambda i: (xxhash.xxh64_intdigest(texts[i].encode(), 42), i))
    load, out = [0] * shards, [None] * len(texts)
    for i in order:
        middle = ((xxhash.xxh64_intdigest(texts[i].encode(), 42) >> (64 - bits)) << (64 - bits)) + (1 << (63 - bits))
        after = [s for at, s in points if at >= middle] + [s for at, s in points if at < middle]
        shard = next(s for s in after if load[s] < capacity[s])
        out[i] = (shard, load[shard])
        load[shard] += 1
    return out


@pytest.mark.parametrize("slack", [0.0, 0.3])
def test_sharding_equals_a_plain_walk(spark, slack):
    rng = random.Random(1)
    texts = [f"text {rng.randrange(150)}" for _ in range(230)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).coalesce(1)
    want = plain_ring(texts, 5, sharding.capacities(len(texts), 5, slack))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, 5, slack=slack).collect()}
    assert got == dict(enumerate(want))


def test_hot_cells_are_dealt_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 40)
    docs = frame(spark, [(i, "one text" if i % 3 else f"text {i}", "s") for i in range(900)])
    rows = sharding.shard(docs).collect()
    counts = [sum(r["shard"] == s for r in rows) for s in range(16)]
    assert len(rows) == 900 and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s])) for s in range(16))


# --- quality -----------------------------------------------------------------------------------------------------


def plain_ftrl(rows, labels):
    """FTRL-proximal as published, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            terms = [(int(i), float(x), weight(int(i)), n[int(i)]) for i, x in zip(*rows[k])]
            p = 1 / (1 + math.exp(-sum(w * x for _, x, w, _ in terms)))
            for i, x, w, before in terms:
                g = (p - labels[k]) * x
                z[i] += g - (math.sqrt(before + g * g) - math.sqrt(before)) / quality.ALPHA * w
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_equals_plain_ftrl_and_dot_products(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    labels = [int(len(t) % 2) for t in texts]
    memory = Remember(quality.word_code)
    rows = [quality.features(t, memory) for t in texts]
    want = plain_ftrl(rows, labels)
    weights = quality.fit_texts(texts, labels)
    assert np.flatnonzero(weights).size and set(np.flatnonzero(weights)) <= set(want)
    assert all(weights[i] == pytest.approx(w, abs=1e-5) for i, w in want.items())
    got = sorted(r["score"] for r in quality.score(docs, weights).collect())
    plain = sorted(1 / (1 + math.exp(-sum(float(weights[i]) * float(x) for i, x in zip(*f)))) for f in rows)
    assert got == pytest.approx(plain, abs=1e-5)


# --- toxicity ----------------------------------------------------------------------------------------------------


def plain_segments(score):
    """All maximal segments by their definition: the best segment, then left and right of it, and so on."""
    best, place = 0.0, None
    for i in range(len(score)):
        total = 0.0
        for j in range(i, len(score)):
            total += score[j]
            if total > best + 1e-9:
                best, place = total, (i, j)
    if place is None:
        return []
    i, j = place
    right = [(a + j + 1, b + j + 1, s) for a, b, s in plain_segments(score[j + 1 :])]
    return plain_segments(score[:i]) + [(i, j, best)] + right


def test_toxicity_equals_plain_segments_and_statistics(spark):
    rng, words = random.Random(5), [f"w{i}" for i in range(30)]
    model = toxicity.Model(np.full(toxicity.WORDS, np.nan), np.array([rng.uniform(-1.5, 1.0) for _ in range(toxicity.STEMS)]), 0.8, 0.2, 0.5, -1.0)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["", None, "w1 w1 w1"]
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        tokens = [w.encode() for w in (t or "").split()]
        score = [-toxicity.DRIFT if k and tokens[k - 1] == w else model.stem[toxicity.stem(w)] for k, w in enumerate(tokens)]
        found = plain_segments(score)
        norm = sorted((0.8 * s - math.log(0.2 * len(tokens)) for _, _, s in found), reverse=True)
        few = norm[:1] + [x for x in norm[1:] if x > 0]
        evidence = max([sum(few[:r]) - math.lgamma(r + 1) for r in range(1, len(few) + 1)], default=toxicity.LOW)
        assert got[i]["evidence"] == pytest.approx(max(evidence, toxicity.LOW), abs=1e-6)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(0.5 * got[i]["evidence"] - 1.0))), abs=1e-6)
        clear = [(a, b) for a, b, s in found if 0.2 * len(tokens) * math.exp(-0.8 * s) <= 0.05]
        assert [(p["first"], p["last"]) for p in got[i]["passages"]] == clear


def test_k_follows_the_maxima_of_clean_texts(spark):
    """With every clean text's best segment known, K is what the mean of Gumbel's law says."""
    word = np.full(toxicity.WORDS, -1.0)
    word[toxicity.crc32(b"good") & (toxicity.WORDS - 1)] = 2.0
    model = toxicity.Model(word, np.full(toxicity.STEMS, -1.0), 0.7, 0.1)
    texts = [("good " + "plain word " * n, 0) for n in (3, 5, 9)] + [("good good", 1), ("", 0)]
    got = toxicity._estimate_k(model, spark.createDataFrame(texts, "text string, y int"))
    assert got.k == pytest.approx(math.exp(np.mean([1.4 - math.log(2 * n + 1) for n in (3, 5, 9)]) - np.euler_gamma))
