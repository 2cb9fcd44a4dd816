"""Registered queries on tables where a cut would show."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.operators import topics
from marginalia.plans import queries


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """5,040 documents; the last 40 have words of their own."""
    path = str(tmp_path_factory.mktemp("late"))
    rows = [(i, f"early{i % 7} word{i % 11} thing{i % 3}" if i < 5000 else f"late{i % 2} end{i % 2} note") for i in range(5040)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_lda_is_fitted_on_all_documents(spark, late):
    model, vectorizer, vectors = queries._lda(spark, late)
    assert {"late0", "late1", "end0", "end1", "note", "early0"} <= set(vectorizer.vocabulary)
    assert model.getK() == 50 and model.getMaxIter() == 10 and vectorizer.getVocabSize() == 50_000
    assert vectors.count() == 5040


def test_neighbours_are_those_of_brute_force_over_bigrams(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"{c}{c}" for c in "abcdefghij"]
    texts = [list(rng.choice(words, 7)) for _ in range(130)]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = [Counter([*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]) for t in texts]
    df = Counter(term for c in counts for term in c)
    vocab = sorted(term for term, n in df.items() if 10 <= n <= 0.6 * len(texts))
    assert any(" " in term for term in vocab)
    x = np.array([[c[term] * (math.log((1 + len(texts)) / (1 + df[term])) + 1) for term in vocab] for c in counts])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    sim = x @ x.T
    np.fill_diagonal(sim, 0.0)
    best = -np.sort(-sim, axis=1)[:, :100]
    for query in (queries.tfidf_knn, queries.tfidf_knn_postings):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == int((best > 0).sum()) and max(r["rank"] for r in rows) == 100
        assert len({(r["id"], r["neighbor_id"]) for r in rows}) == len({(r["id"], r["rank"]) for r in rows}) == len(rows)
        for r in rows:
            assert r["sim"] == pytest.approx(sim[r["id"], r["neighbor_id"]], abs=1e-6)
            assert r["sim"] == pytest.approx(best[r["id"], r["rank"] - 1], abs=1e-6)


def test_nmf_knows_terms_beyond_the_most_frequent(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 100 + j) % 2500}" for j in range(100))) for i in range(400)]
    rows += [(400 + i, " ".join(f"rare{j}" for j in range(10))) for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model, weights = queries._nmf(spark, str(tmp_path))
    assert len(model.vocabulary) > 2500 and {"rare0", "rare0 rare1", "w1 w2"} <= set(model.vocabulary)
    got = {r["id"]: r["vec"] for r in model.transform(weights, queries.docs_of(spark, str(tmp_path))).collect()}
    assert len(got) == 410 and all(len(v) == 50 and max(v) > 0 for v in got.values())
    assert queries.vocab_prune(spark, str(tmp_path)).count() == len(model.vocabulary)


def test_nmf_blocks_are_the_rows():
    """Packed blocks hold every row once, and W solves each row's least squares with no negative factor."""
    rng = np.random.default_rng(2)
    x = rng.random((300, 40)) * (rng.random((300, 40)) < 0.3)
    x[:, 0] = 0.5
    rows = [np.flatnonzero(r) for r in x]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(rows, pa.list_(pa.int32())), pa.array([x[i, r] for i, r in enumerate(rows)])], names=["id", "at", "ws"])
    h = rng.random((4, 40))
    seen = []
    for ids, some, part in topics.Nmf._dense(topics.Nmf._pack(iter([batch.slice(0, 130), batch.slice(130)]))):
        assert np.allclose(part, x[np.ix_(ids.as_py(), some)], atol=1e-6) and len(part) <= topics.ROWS
        w = topics.Nmf._solve(part @ h.T[some], h @ h.T, 200).T
        slope = w @ (h @ h.T) - part @ h.T[some]
        assert (w >= 0).all() and (slope > -1e-4).all() and np.abs(slope[w > 1e-6]).max() < 1e-4
        seen += ids.as_py()
    assert seen == list(range(300))


@pytest.mark.parametrize("start", ["nndsvda", "random"])
def test_nmf_factors_are_found_saved_and_loaded(spark, tmp_path, start):
    """A matrix of rank 3 is factorised almost fully; saved factors give the same vectors."""
    rng = np.random.default_rng(4)
    x = (rng.random((90, 3)) * (rng.random((90, 3)) < 0.6)) @ (rng.random((3, 30)) * (rng.random((3, 30)) < 0.5))
    weights = spark.createDataFrame([(int(i), f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id long, term string, w double")
    vocab = weights.select("term").distinct()
    model = topics.Nmf(3, start=start, tolerance=1e-7).fit(weights, vocab)
    assert model.objective[-1] < 0.02 * (x * x).sum() and all(b <= a * 1.001 + 1e-3 for a, b in zip(model.objective, model.objective[1:]))
    model.save(spark, f"{tmp_path}/nmf")
    again = topics.Nmf.load(spark, f"{tmp_path}/nmf")
    assert again.vocabulary == model.vocabulary and np.allclose(again.h, model.h)
    a, b = (sorted((r["id"], r["vec"]) for r in m.transform(weights).collect()) for m in (model, again))
    assert np.allclose([v for _, v in a], [v for _, v in b]) and model.keywords(spark, 4).collect() == again.keywords(spark, 4).collect()
    empty = topics.Nmf(3, start=start).fit(weights.limit(0), vocab.limit(0))
    assert empty.objective == [] and empty.keywords(spark).count() == 0


def test_lda_is_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"aa{i % 2} bb{i % 2} cc{i % 3}") for i in range(60)], "id long, text string")
    model, vectorizer, vectors = topics.lda(docs, topics=2, min_df=1, max_df=1.0, iterations=3)
    topics.save_lda(model, vectorizer, f"{tmp_path}/lda")
    model2, vectorizer2 = topics.load_lda(f"{tmp_path}/lda")
    assert vectorizer2.vocabulary == vectorizer.vocabulary
    assert sorted(topics.lda_keywords(model2, vectorizer2).collect()) == sorted(topics.lda_keywords(model, vectorizer).collect())
