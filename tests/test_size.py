"""Steps whose memory and traffic must not grow with the table."""

import html
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.functions import clean, text
from marginalia.operators import ingest, similarity, topics, works
from marginalia.plans import queries
from marginalia.sources import jsonl


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_within_rows(spark):
    """No table of terms is hashed or shuffled by document; repeated ids are one document."""
    rows = [(1, "bb aa bb"), (2, ""), (3, None), (4, "cc"), (4, "aa cc"), (None, "dd")]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {(r["id"], r["term"]): r["tf"] for r in similarity.term_counts(docs, text.terms(F.col("text"))).collect()}
    assert got == {(1, "aa"): 1, (1, "bb"): 2, (1, "bb aa"): 1, (1, "aa bb"): 1, (4, "aa"): 1, (4, "cc"): 2, (4, "aa cc"): 1, (None, "dd"): 1}
    unique = docs.where("id <> 4")
    assert "HashAggregate" not in plan_of(similarity.term_counts(unique, text.terms(F.col("text"))))
    many = similarity.term_counts(unique, text.terms(F.col("text")))
    assert many.groupBy("term").count().count() == 4


def test_parts_grow_with_the_texts(spark, monkeypatch):
    docs = spark.range(400).select("id", F.lit("some words here " * 20).alias("text"))
    monkeypatch.setattr(similarity, "PART", 1 << 12)
    counts = similarity.term_counts(docs, text.terms(F.col("text"), 1))
    assert counts.rdd.getNumPartitions() == -(-400 * 320 // (1 << 12))
    assert counts.count() == 800


def test_vocabulary_is_pruned_from_bounded_parts(spark, tmp_path, monkeypatch):
    """The vocabulary is the same however finely the texts are dealt, and no task gets more than its part."""
    rows = [(i, f"every word{i % 3} rare{i}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(similarity, "PART", 1 << 7)
    counts = queries.counts_of(spark, str(tmp_path))
    assert counts.rdd.getNumPartitions() >= 8
    got = {r["term"]: (r["df"], r["cf"]) for r in queries.vocab_prune(spark, str(tmp_path)).collect()}
    assert got == {**{f"word{k}": (20, 20) for k in range(3)}, **{f"every word{k}": (20, 20) for k in range(3)}}


def test_nmf_sends_one_sum_per_core(spark):
    """However many parts the blocks have, a round's sums as wide as the vocabulary are as many as tasks run at a time."""
    rows = spark.range(200).select("id", F.array(F.lit(0), F.lit(1)).alias("at"), F.array(F.lit(0.6), F.lit(0.8)).alias("ws"))
    model = topics.Nmf(2)
    model.vocabulary, model.parts = ["aa", "bb"], 40
    blocks = model.packed(rows.repartition(40))

    def step(batches):
        n = sum(len(ids) for ids, _, _ in topics.Nmf._dense(batches))
        return np.full((2, 12), n, np.float32), np.ones(1)

    wide, tasks = model._reduced(blocks, step, 1)
    assert (wide == 200).all() and round(tasks[0]) <= spark.sparkContext.defaultParallelism


def test_weights_of_terms_move_no_terms(spark, tmp_path):
    """Rows of weights equal the joined form; nothing but texts is shuffled for them, repeated ids are one document."""
    rows = [(i // 2, f"aa{i % 3} bb{i % 2} cc{i % 5}") for i in range(40)] + [(99, "zz")]
    docs = spark.createDataFrame(rows, "id long, text string")
    words = text.terms(F.col("text"))
    counts = similarity.term_counts(docs, words)
    vocab = similarity.vocabulary(counts, 21, 3, 1.0, 50)
    found, names = similarity.tfidf_rows(docs, words, vocab, 21)
    want = {(r["id"], r["term"]): r["w"] for r in similarity.tfidf(counts, vocab, 21).collect()}
    got = {(r["id"], r["term"]): r["w"] for r in similarity.entries(found, names).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "Join" not in plan_of(found) and plan_of(queries.rows_of(spark, "/root/testdata/sf0.001")[0]).count("Exchange") <= 2
    none, names = similarity.tfidf_rows(docs, words, vocab.limit(0), 21)
    assert none.count() == 0 and similarity.entries(none, names).count() == 0


def test_neighbours_meet_in_groups(spark):
    """A row is sent once for each group, not for each block; ties and repeated texts keep their order."""
    rng = np.random.default_rng(3)
    at = [sorted(rng.choice(12, 4, replace=False).tolist()) for _ in range(300)]
    rows = spark.createDataFrame([(i, a, [0.5] * 4) for i, a in enumerate(at)], "id long, at array<int>, ws array<double>")
    x = np.zeros((300, 12))
    for i, a in enumerate(at):
        x[i, a] = 0.5
    sim = np.round(x @ x.T, 6)
    np.fill_diagonal(sim, 0)
    want = {}
    for i in range(300):
        order = np.lexsort((np.arange(300), -sim[i]))[:7]
        want |= {(i, r): (int(j), float(sim[i, j])) for r, j in enumerate(order, 1) if sim[i, j] > 0}
    for group, block, dense in ((1000, 64, 0.01), (70, 16, 0.01), (70, 16, similarity.NEVER)):
        found = similarity.knn_rows(rows, 12, 300, 7, dense=dense, group=group, block=block)
        assert {(r["id"], r["rank"]): (r["neighbor_id"], r["sim"]) for r in found.collect()} == want


def shuffled(spark, since=0):
    """(rows written to shuffles by the stages from number ``since`` on, the next stage's number)."""
    ctx = spark.sparkContext
    ctx._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = ctx._jsc.sc().statusStore().stageList(None, False, False, ctx._gateway.new_array(ctx._jvm.double, 0), ctx._jvm.java.util.ArrayList())
    found = {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(i) for i in range(stages.size()))}
    return sum(n for (i, _), n in found.items() if i >= since), max((i for i, _ in found), default=-1) + 1


def test_neighbours_are_not_shuffled_for_each_group(spark):
    """Rows are dealt once, however many groups there are, and lists of best stay with their rows."""
    rng = np.random.default_rng(4)
    rows = [(i, sorted(rng.choice(40, 6, replace=False).tolist()), [6**-0.5] * 6) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, at array<int>, ws array<double>")
    _, since = shuffled(spark)
    found = {(r["id"], r["rank"]): (r["neighbor_id"], r["sim"]) for r in similarity.knn_rows(df, 40, 400, 5, group=40, block=16).collect()}
    # Rows, and a count of records for each group; a copy of each row for each group would be over 4,000.
    assert shuffled(spark, since)[0] < 800
    assert found == {(r["id"], r["rank"]): (r["neighbor_id"], r["sim"]) for r in similarity.knn_rows(df, 40, 400, 5).collect()} and len(found) == 2000


def test_products_of_single_precision_are_ranked_exactly():
    """Labels, slices and single precision change no rank: products that differ by less than it tells are told apart."""
    rng = np.random.default_rng(9)
    n, v = 700, 60
    x = rng.random((n, v)) * (rng.random((n, v)) < 0.3)
    x[300:420] = x[300] * (1 + 1e-6 * rng.random((120, v)))
    x /= np.maximum(1e-12, np.sqrt((x * x).sum(axis=1, keepdims=True)))
    at = [np.flatnonzero(r).astype(np.int32) for r in x]
    table = pa.table({"id": pa.array(range(n), pa.int64()), "at": pa.array(at, pa.list_(pa.int32())), "ws": pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float64()))})
    rows = similarity.Sparse.of(similarity.alike(table).combine_chunks())
    assert sorted(rows.ids.tolist()) == list(range(n)) and len(set(rows.label.tolist())) > 1
    sim = np.round(x @ x.T, 6)
    np.fill_diagonal(sim, 0)
    for dense in (0.003, 0.2, similarity.NEVER):
        top = similarity._Top(rows.ids, 9, 6)
        similarity._meet_sparse(v, dense)(rows, rows, top, 64)
        for r in top.rows().to_pylist():
            order = np.lexsort((np.arange(n), -sim[r["id"]]))[:9]
            assert r["sims"] == np.rint(sim[r["id"], order] * 1e6).astype(int).tolist() and r["names"] == order.tolist()


def test_best_of_slices_keeps_ties_to_the_smaller_id():
    top = similarity._Top(np.array([5]), 2, 6)
    for names, sims in (([9, 8, 7], [0.5, 0.5, 0.2]), ([3, 4, 2], [0.5, 0.4, 0.5000001]), ([1, 6, 10], [0.0, 0.1, 0.0])):
        top.add(0, np.array([sims]), np.array(names))
    assert top.rows().to_pylist() == [{"id": 5, "names": [2, 3], "sims": [500000, 500000]}]


def test_entities_alone_go_to_python(spark):
    """All entities are decoded as html.unescape does; what is sent to Python is them, not the texts."""
    texts = ["", "no entity", "&amp;", "a &lt;b&gt; &amp;amp; c", "&notit; &notin; &#65;&#x42;C &#x110000; &#0; &", "&&amp;&;&#;", "\N{GRINNING FACE}&eacute\N{GRINNING FACE}&" + "x" * 40, "&hellip;\n&copy &nbsp;", None, "&#128;&#xD800; $1 \\1 &bogus;"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = df.select("id", clean.unescape_apart(F.col("t")).alias("t"))
    assert {r["id"]: r["t"] for r in found.collect()} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    evaluated = [x for x in plan_of(df.select(clean.description(F.col("t"), apart=True))).splitlines() if "ArrowEvalPython" in x]
    assert len(evaluated) == 1 and "regexp_extract_all" in plan_of(found)


def test_vectors_are_sent_once_for_each_group(spark, monkeypatch):
    """More blocks make no more copies: 12 blocks in 4 groups, each row in 4 meetings; repeated ids share their ranks."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((600, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(similarity, "DENSE_GROUP", 150)
    found = similarity.vector_knn(df, 5, block=50).collect()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    np.fill_diagonal(sim, 0)
    for r in found:
        order = np.lexsort((np.arange(600), -sim[r["id"]]))
        assert r["neighbor_id"] == order[r["rank"] - 1]
    assert len(found) == 3000 and plan_of(similarity.vector_knn(df, 5, block=50)).count("Scan ExistingRDD") == 1


def test_first_generation_tags_are_merged_in_one_pass(spark):
    shelves = spark.createDataFrame([(1, " Fantasy ", 5), (1, "fantasy", 7), (1, "award winner", 2), (1, "to read", 9), (2, "History", None), (3, None, 4)], "book_id long, shelf string, count long")
    found = works.book_tags_first_generation(shelves, 2)
    assert found.columns == ["book_id", "shelf", "weight", "kind"]
    assert [r["weight"] for r in found.where("shelf = 'fantasy'").collect()] == [7]
    books = spark.createDataFrame([(i,) for i in range(1, 5)], "book_id long")
    merged = works.merge_tags_first_generation(books, found, 2, weights=True)
    rows = {r["book_id"]: (r["genres_top"], r["badges_top"], r["genres_top_weights"]) for r in merged.collect()}
    assert rows[1] == ("fantasy", "award winner", "fantasy:7") and rows[2] == ("history", "", "history:0") and rows[3] == rows[4] == ("", "", "")
    assert plan_of(works.merge_tags_first_generation(books, found, 2, weights=True)).count("LeftOuter") == 1


def test_lda_inference_is_that_of_single_documents():
    """Slices of documents of like length, and the last few of them taken together, give what a plain loop gives."""
    rng = np.random.default_rng(8)
    size = rng.integers(0, 30, 60)
    ends, tf = np.r_[0, np.cumsum(size)], rng.integers(1, 4, size.sum()).astype(np.float32)
    at = np.concatenate([np.sort(rng.choice(200, n, replace=False)) for n in size])
    lam, alpha, gamma = rng.gamma(1, 1, (4, 200)), np.full(4, 0.25), np.ones((60, 4))
    beta = np.exp(topics._psi(lam) - topics._psi(lam.sum(axis=1, keepdims=True))).T
    topics.Bayes._infer(ends, at, tf, gamma, beta.astype(np.float32), alpha)
    for d, n in enumerate(size):
        g, b, change = np.ones(4), beta[at[ends[d] : ends[d + 1]]], 1.0
        while n and change > 1e-5:
            theta = np.exp(topics._psi(g) - topics._psi(g.sum()))
            new = alpha + theta * (b.T @ (tf[ends[d] : ends[d + 1]] / (b @ theta)))
            g, change = new, np.abs(new - g).mean()
        assert np.abs(g - gamma[d]).max() < 0.2 + 0.01 * tf[ends[d] : ends[d + 1]].sum()
    x = np.array([0.02, 0.5, 1.0, 7.0])
    assert np.allclose(np.diff([topics._psi(x), topics._psi(x + 1)], axis=0), 1 / x) and np.allclose(np.diff([topics._psi1(x + 1), topics._psi1(x)], axis=0), 1 / x**2)
    assert abs(topics._psi(np.array([1.0]))[0] + 0.5772156649) < 1e-9 and abs(topics._psi1(np.array([1.0]))[0] - np.pi**2 / 6) < 1e-8


def test_lda_iterations_keep_the_documents_weights(spark):
    """A document's inference goes on from its last iteration; its final shares are read from there, none is left out."""
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{i % 3}{c}" for c in "abcdef")) for i in range(90)] + [("none", "")], "id string, text string")
    model, vectorizer, vectors = topics.lda(docs, topics=3, min_df=1, max_df=1.0, iterations=6, fit_docs=None)
    assert "InMemoryTableScan" in plan_of(vectors)
    got = {r["id"]: r["vec"] for r in vectors.collect()}
    assert len(got) == 91 and got.pop("none") == [0.0] * 3 and all(abs(sum(v) - 1) < 1e-5 for v in got.values())
    assert all(np.allclose(got[f"d{i}"], got[f"d{i % 3}"], atol=1e-3) for i in range(90))
    assert type(model).__name__ == "LocalLDAModel" and model.getMaxIter() == 6 and model.vocabSize() == 18
    assert topics.lda_keywords(model, vectorizer, 4).count() == 3


def test_totals_of_terms_follow_the_texts(spark, monkeypatch):
    """Both tables of terms are dealt over parts that follow the bytes of text, not over the session's partitions."""
    rows = [(i // 2 if i < 20 else i, f"every word{i % 3} rare{i}" if i % 7 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "id long, text string")
    words = text.terms(F.col("text"))
    want = similarity.term_counts(docs, words).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    monkeypatch.setattr(similarity, "PART", 1 << 7)
    found = similarity.term_totals(docs, words)
    assert sorted(found.collect()) == sorted(want.collect())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert found.rdd.getNumPartitions() == -(-size // (1 << 7)) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = similarity.term_totals(docs.where("id >= 20"), words)
    assert plan_of(unique).count("Exchange") == 2


def test_lines_are_made_once_and_lists_only_where_needed(spark, tmp_path):
    """Filters on a line don't make it again below them; lists of records that plain fields reject are not taken apart."""
    spark.sql("select id as o_orderkey, '1-URGENT' as o_orderpriority, timestamp_ntz'2001-02-03' as o_orderdate, 1e5 as o_totalprice from range(2000)").write.parquet(f"{tmp_path}/orders.parquet")
    found = queries.reject_reasons(spark, str(tmp_path))
    assert plan_of(found).count("StructsToJsonEvaluator") == 1
    good = {"id": "1", "title": "t", "description": "d", "isbn": "i", "isbn13": "j", "language": "eng", "publication_date": "2001", "original_publication_date": "2001", "publisher": "p", "rating_dist": "5:1", "ratings_count": "2", "average_rating": "4", "num_pages": "3", "author_id": "7", "author_name": "N", "authors": [{"id": "1", "name": "A"}], "shelves": [{"name": "s", "count": 1}]}
    lines = [json.dumps(good), "\ufeff " + json.dumps({**good, "id": "2", "title": " "}) + " \t", json.dumps({**good, "id": "3", "title": " é", "shelves": 5}), None, " "]
    rows = {r["id"]: r for r in ingest.validate(jsonl.parse(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    assert {k: r["reject_reason"] for k, r in rows.items()} == {"1": None, "2": "missing_title", "3": "shelves_not_list"}
    assert rows["1"]["shelf_list"] and rows["1"]["author_list"] and rows["2"]["shelf_list"] is None and rows["2"]["author_list"] is None


def test_rare_terms_are_not_shuffled_for_a_vocabulary(spark, tmp_path):
    """Terms that can't be in the vocabulary are left out before any shuffle; before, each moved with its count."""
    rows = [(i, f"all{i % 40} " + " ".join(f"rare{i}x{j}" for j in range(30))) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    since = shuffled(spark)[1]
    got = {r["term"]: (r["df"], r["cf"]) for r in queries.vocab_prune(spark, str(tmp_path)).collect()}
    assert got == {f"all{k}": (25, 25) for k in range(40)}
    assert shuffled(spark, since)[0] < 10_000  # of 61,000 terms


def test_vocabulary_is_that_of_all_terms(spark, monkeypatch):
    """Whatever the buckets hold: few of them, terms over the bounds, ties at the end, repeated ids, nothing at all."""
    rng = np.random.default_rng(8)
    rows = [(i // 2 if i < 40 else i, " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 40), 3000))) for i in range(300)]
    rows += [(1000 + i, f"junk{i} " * 500) for i in range(30)] + [(2000, ""), (2001, None), (None, "w5 w7")]
    docs, words = spark.createDataFrame(rows, "id long, text string"), text.terms(F.col("text"))
    totals = similarity.term_totals(docs, words).persist()
    made = []
    whole = similarity.term_totals
    monkeypatch.setattr(similarity, "term_totals", lambda *a: made.append(a[3]) or whole(*a))
    for buckets, most, spare in ((1 << 22, 80_000, 2), (1 << 22, 20, 1), (1 << 12, 20, 2), (1 << 12, 60, 1), (64, 5, 2), (64, 50, 2)):
        monkeypatch.setattr(similarity, "BUCKETS", buckets)
        monkeypatch.setattr(similarity, "SPARE", spare)
        want = [tuple(r) for r in similarity.vocabulary(totals, 300, 3, 0.6, most).collect()]
        assert [tuple(r) for r in similarity.frequent_terms(docs, words, 300, 3, 0.6, most).collect()] == want and want
    assert any(x is None for x in made) and any(x is not None for x in made) and len(made) > 6
    assert similarity.frequent_terms(docs.limit(0), words, 0).count() == 0


def test_texts_of_one_part_are_dealt_for_bucket_sums(spark):
    """A table whose rows lie in one of many parts keeps no core idle; even parts aren't shuffled."""
    docs = spark.range(0, 100, 1, 8).select("id", F.lit("two words").alias("text"))
    assert similarity._per_core(docs).rdd.getNumPartitions() == 4 and "Exchange" not in plan_of(similarity._per_core(docs))
    assert "Exchange" in plan_of(similarity._per_core(docs.where("id < 10")))
    assert similarity.bucket_sums(docs.where("id < 10"), text.terms(F.col("text"))).sum() == 30
