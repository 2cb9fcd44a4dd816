"""The operators on hand-written edge rows, and invariants of models and searches."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import clean, sets, tags, text, vectors
from marginalia.operators import ingest, ranking, similarity, topics, works
from marginalia.plans import catalog, first_generation, report
from marginalia.sources import jsonl, tables
from marginalia.streaming import ingest as stream

GOOD = {
    "id": "1", "work_id": "10", "title": "T", "description": "A&amp;B<br/>c &lt;i&gt;d", "isbn": "i", "isbn13": "j", "language": "eng",
    "publication_date": "2005-03-14", "original_publication_date": "1999", "publisher": "p", "rating_dist": "5:10|4:x|5:12|total:30|7:1",
    "ratings_count": "2", "average_rating": "4.02", "num_pages": "299", "author_id": "7", "author_name": "N",
    "authors": [], "shelves": [{"name": " sf ", "count": None}],
}


def records(spark, *changes):
    lines = [json.dumps({**GOOD, **c}) if isinstance(c, dict) else c for c in changes]
    return jsonl.parse(spark.createDataFrame([(x,) for x in lines], "value string"))


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_reader_takes_objects_only(spark):
    rows = records(spark, "", "  ", "[1]", '[{"id":1}]', '{"id":1}', '\t{"id": 2, "id": 3} ').select("id").collect()
    assert sorted(r["id"] for r in rows) == ["1", "3"]
    with pytest.raises(Exception, match="MALFORMED|not JSON"):
        records(spark, "{bad").collect()
    with pytest.raises(Exception, match="not JSON"):
        records(spark, "bad").collect()
    lines = spark.createDataFrame([("{bad",), ("bad",), ('{"id":1}',)], "value string")
    assert [r["id"] for r in jsonl.parse(lines, strict=False).collect()] == ["1"]


REASONS = [
    ({"title": "  "}, "missing_title"), ({"title": None, "isbn": None}, "missing_title"), ({"title": " \t"}, "missing_title"),
    ({"language": None}, "language_not_eng"), ({"language": "en"}, "language_not_eng"), ({"language": "eng "}, "language_not_eng"),
    ({"ratings_count": "abc"}, "missing_ratings_count"), ({"ratings_count": "1"}, "ratings_count_le_1"), ({"ratings_count": 2, "average_rating": 0}, None),
    ({"average_rating": "x"}, "missing_average_rating"), ({"num_pages": None}, "missing_num_pages"), ({"num_pages": -1}, "num_pages_le_0"),
    ({"shelves": {}}, "shelves_not_list"), ({"shelves": "[1]"}, "shelves_not_list"), ({"shelves": []}, "shelves_empty"), ({"shelves": [3]}, None),
    ({"author_id": None, "authors": [{"id": "7", "name": "A"}]}, None), ({"author_id": None, "authors": [{"name": "A"}]}, "missing_author_id_or_name"),
    ({"author_name": " ", "authors": ["x", {"author_id": 0, "id": 5, "name": "B"}]}, None), ({"id": None}, "missing_id"), ({"rating_dist": ""}, "missing_rating_dist"), ({}, None),
]


def test_reject_reasons(spark):
    rows = ingest.validate(records(spark, *[{**c, "work_id": i} for i, (c, _) in enumerate(REASONS)])).select("work_id", "reject_reason").collect()
    assert {int(r["work_id"]): r["reject_reason"] for r in rows} == {i: reason for i, (_, reason) in enumerate(REASONS)}
    rate = ingest.keep_rate(ingest.validate(records(spark, {}, {"id": ""}))).first()
    assert (rate["seen"], rate["kept"], rate["keep_rate"]) == (2, 1, 0.5)


def test_flat_tables(spark):
    kept = ingest.validate(records(
        spark, {}, {"id": "2", "author_id": None, "authors": [{"id": "7", "name": "A"}]}, {"id": "3", "authors": ["x", {"author_id": 0, "id": 5, "name": "B"}, {"name": "C"}]},
        {"id": "4", "authors": [{"name": "C"}], "description": "<p></p>", "shelves": [{"name": "a", "count": "3"}, {"name": " "}, 5]},
    ))
    b = {r["book_id"]: r for r in ingest.books(kept).collect()}
    assert len(b[1].__fields__) == 32 and b[1]["description"] == "A&B c d" and b[4]["description"] is None
    assert [b[1][f"rating_{k}"] for k in (5, 4, 3, 2, 1, "total")] == [12, None, None, None, None, 30]
    assert (b[1]["publication_year"], b[1]["page_bucket"], b[2]["author_id"]) == (2005, "medium", None)
    links = sorted((r["book_id"], r["author_id"], r["author_order"]) for r in ingest.book_authors(kept).collect())
    assert links == [(1, 7, 0), (2, 7, 0), (3, 5, 1)]
    shelves = sorted((r["book_id"], r["shelf"], r["count"]) for r in ingest.book_shelves(kept).collect() if r["book_id"] in (1, 4))
    assert shelves == [(1, " sf ", None), (4, "a", 3)]


def test_years_and_buckets(spark):
    for value, want in (("2005-03-14", 2005), ("2005-3-14", 2005), ("20050314", None), ("12005", None), ("May 2001", 2001), (None, None)):
        assert one(spark, clean.year, value) == want
    assert one(spark, lambda c: clean.year_of_either(F.lit("0000-01-01"), c), "1999") == 1999
    want = [None, "short", "medium", "medium", "long", "long", "epic"]
    assert [one(spark, clean.page_bucket, n, "int") for n in (None, 99, 100, 299, 300, 599, 600)] == want


def test_cleaning(spark):
    assert one(spark, clean.description, "A&amp;B<br/>c &lt;i&gt;d  e") == "A&B c d e"
    assert one(spark, clean.description, "<p></p>") == ""
    assert one(spark, clean.clean_first_generation, "Café at www.x.com, mail a@b.co!") == "caf at url mail email"
    assert one(spark, clean.clean_first_generation, None) == ""
    assert one(spark, clean.description, "&eacute;&hellip;") == "é…"


def test_tag_names_and_kinds(spark):
    assert one(spark, tags.normal_name, "  Sci   Fi ") == "sci-fi" and one(spark, lambda c: tags.normal_name(c, 1), "  Sci   Fi ") == "sci fi"
    names = ["to-read", "library", "lewis-library", "classics", "hugo-award", "fantasy", "3-stars", "uk0-lib", "myfavoritebooks"]
    assert [one(spark, tags.kind, n) for n in names[:8]] == ["drop", "drop", "badge", "genre", "badge", "genre", "drop", "badge"]
    assert [one(spark, lambda c: tags.kind(c, 1), n) for n in ("lewis-library", "classics", "uk0-lib", "myfavoritebooks")] == ["drop", "badge", "drop", "badge"]


def test_tag_sums(spark):
    shelves = spark.createDataFrame([(1, "Sci Fi", 3), (2, " sci-fi", 2), (1, "none", None), (1, "zero", 0), (1, "to-read", 9)], "book_id long, shelf string, count long")
    editions = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "book_id long, work_id long")
    got = works.tag_sums(shelves, editions)
    assert sorted((r["shelf"], r["count"]) for r in got.collect()) == [("sci-fi", 2), ("sci-fi", 3)]
    assert works.joined_tags(got, "g").first()["g"] == "sci-fi|sci-fi"
    assert [(r["shelf"], r["count"]) for r in works.tag_sums(shelves, editions, reaggregate=True).collect()] == [("sci-fi", 5)]


def test_first_generation_tags(spark):
    shelves = spark.createDataFrame([(1, "A", None), (1, "b", 0), (1, "a", -3), (1, "hugo", 5), (1, "B ", 4)], "book_id long, shelf string, count long")
    tag = works.book_tags_first_generation(shelves)
    assert sorted((r["shelf"], r["weight"], r["kind"]) for r in tag.collect()) == [("a", 0, "genre"), ("b", 4, "genre"), ("hugo", 5, "badge")]
    merged = works.merge_tags_first_generation(spark.createDataFrame([(1,), (2,), (None,)], "book_id long"), tag, weights=True)
    got = {r["book_id"]: (r["genres_top"], r["badges_top"], r["genres_top_weights"]) for r in merged.collect()}
    assert got == {1: ("b|a", "hugo", "b:4|a:0"), 2: ("", "", ""), None: ("", "", "")}


def test_representatives_pick_each_column_apart(spark):
    rows = spark.createDataFrame([(1, 5, None, "p", 10), (1, 6, "x", None, 5), (1, 7, "y", "q", 5), (2, 8, None, None, 1)], "work_id long, book_id long, title string, pub string, score long")
    got = {r["work_id"]: tuple(r)[1:] for r in works.representatives(rows, ["title", "pub"]).collect()}
    assert got == {1: (5, "x", "p"), 2: (8, None, None)}
    assert spark.range(1).select(works.packed_score(F.lit(1), F.lit(3), F.lit(4.02))).first()[0] == 10**15 + 3 * 10**6 + 4020
    for g, b, want in ((None, None, None), ("g", None, "g"), (None, "b", "b"), ("g", "b", "g|b")):
        assert spark.range(1).select(works.combined_tags(F.lit(g).cast("string"), F.lit(b).cast("string"))).first()[0] == want


def test_sets_and_vectors(spark):
    for a, b, want in (("", None, 0.0), ("a", "", 0.0), ("a|b|", "b|c|b", 1 / 3)):
        assert spark.createDataFrame([(a, b)], "a string, b string").select(sets.jaccard(sets.token_set(F.col("a")), sets.token_set(F.col("b")))).first()[0] == pytest.approx(want)
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 9, 0.4)], "work_id long, neighbor_work_id long, sim_tfidf float")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0])], "id long, vec array<float>")
    got = {r["neighbor_work_id"]: r["s"] for r in ranking.add_similarity(pairs, vecs, "s", missing="zero").collect()}
    assert got == {2: pytest.approx(0.6), 9: 0.0}
    with pytest.raises(Exception, match="no vector for"):
        ranking.add_similarity(pairs, vecs, "s").collect()


def test_terms(spark):
    assert one(spark, lambda c: text.terms(c), "The cat and a hat, the 2nd x") == ["The", "cat", "hat", "2nd", "The cat", "cat hat", "hat 2nd"]
    assert one(spark, lambda c: text.terms(c, 3), "one_two") == ["one_two"] and one(spark, lambda c: text.terms(c), "") == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abc ", min_size=0, max_size=12), min_size=3, max_size=14), st.integers(1, 4))
def test_searches_agree_and_rank(spark, texts, k):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    counts = similarity.term_counts(docs, F.split("text", " "))
    weights = similarity.tfidf(counts, similarity.vocabulary(counts, len(texts), 1, 1.0, None), len(texts))
    a = sorted(map(tuple, similarity.knn_postings(weights, k).where("sim > 0").collect()))
    b = sorted(map(tuple, similarity.knn_blocks(weights, k, block=3).collect()))
    assert a == b and all(i != j and 0 < s <= 1.000001 for i, j, s, _ in a)
    for i in {x[0] for x in a}:
        assert sorted(x[3] for x in a if x[0] == i) == list(range(1, sum(x[0] == i for x in a) + 1))
    padded = similarity.pad_with_zeros(similarity.knn_blocks(weights, k), docs.select("id"), k).groupBy("id").count().collect()
    assert {r["count"] for r in padded} == {min(k, len(texts) - 1)}


def test_vocabulary_bounds(spark):
    rows = [(d, t) for d in range(10) for t in (["every"] + (["half"] if d % 2 else []) + (["rare"] if d == 3 else []))]
    counts = spark.createDataFrame(rows, "id long, term string").groupBy("id", "term").agg(F.count("*").alias("tf"))
    assert [r["term"] for r in similarity.vocabulary(counts, 10, 2, 0.6).collect()] == ["half"]
    assert len(similarity.vocabulary(counts, 10, 1, 1.0, 2).collect()) == 2


def test_topic_models(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice([f"word{i % 3}{c}" for c in "abcdefgh"], 12))) for i in range(90)] + [(90, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    model, vectorizer, vecs = topics.lda(docs, topics=3, min_df=1, max_df=1.0, iterations=5, fit_docs=60)
    assert {len(r["vec"]) for r in vecs.collect()} == {3} and vecs.count() == 91
    words = topics.lda_keywords(model, vectorizer, 5).collect()
    assert len(words) == 3 and all(len(r["top_words"].split("|")) == 5 for r in words)
    counts = similarity.term_counts(docs, text.terms(F.col("text"), 1))
    vocab = similarity.vocabulary(counts, 91, 1, 1.0, 100)
    weights = similarity.tfidf(counts, vocab, 91)
    nmf = topics.Nmf(3, iterations=10).fit(weights, vocab)
    assert (nmf.h >= 0).all() and nmf.objective[-1] < nmf.objective[0]
    assert all(b <= a * 1.01 for a, b in zip(nmf.objective, nmf.objective[1:]))
    got = {r["id"]: r["vec"] for r in nmf.transform(weights, docs).collect()}
    assert len(got) == 91 and got[90] == [0.0] * 3 and min(min(v) for v in got.values()) >= 0
    assert {len({int(np.argmax(got[i])) for i in range(j, 90, 3)}) for j in range(3)} == {1}
    assert nmf.keywords(spark, 4).count() == 3


def test_serving_and_samples(spark):
    works_ = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "work_id long, title string")
    pairs = spark.createDataFrame([(0, j, 0.1 * j, j, 0.5, 0.2 * j) for j in range(4)], "work_id long, neighbor_work_id long, sim_tfidf float, rank_tfidf int, sim_lda float, sim_nmf float")
    for materialize in (False, True):
        names = ranking.publish_serving(works_, pairs, ["title"], 3, materialize)
        assert len(names) == 9
        rows = spark.sql("SELECT * FROM v_recs_equal ORDER BY rank_variant").collect()
        assert [r["rec_work_id"] for r in rows] == [3, 2, 1] and rows[0]["rec_title"] == "t3" and rows[0]["score_eq"] > 0
        assert all(r["score_eq"] is None for r in spark.sql("SELECT * FROM v_recs_lda").collect())
        for n in names:
            tables.drop(spark, n)
    a, b = (sorted(r["work_id"] for r in ranking.sample_exact(works_, 2, "work_id").collect()) for _ in range(2))
    assert a == b and len(a) == 2


def test_sinks(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    tables.write_parquet(df, f"{tmp_path}/a", partition_by=["k"], rows_per_file=10)
    assert tables.scan(spark, f"{tmp_path}/a", ["id"], ["id"]).count() == 100
    tables.write_csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 100
    tables.write_ids(df, "id", f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t").count() == 100
    assert tables.scan_sql(spark, f"{tmp_path}/a", "SELECT * FROM source WHERE id < :n", n=7).count() == 7
    assert tables.facts(tables.from_rows(spark, [(1,)], "x int")).first()["n_rows"] == 1


def book_lines(n):
    rng = np.random.default_rng(1)
    words = [f"w{c}{d}" for c in "abcdef" for d in "xyzuv"]
    for i in range(n):
        text_ = " ".join(rng.choice(words, 30)) + " &amp; <b>more</b>"
        shelves = [{"name": s, "count": int(rng.integers(0, 9))} for s in rng.choice(["Fantasy", "sci fi", "hugo award", "to-read"], 2)]
        yield json.dumps({**GOOD, "id": str(i), "work_id": str(i // 2), "description": text_, "ratings_count": int(i % 5 + 2), "shelves": shelves, "language": "eng" if i % 7 else "fre"})


def test_whole_catalog_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = list(book_lines(80))
    (source / "a.json").write_text("\n".join(lines[:50]) + "\n")
    (source / "b.json").write_text("\n".join(lines[50:]) + "\n[1]\n\n")
    config = catalog.Config(k=5, min_df=2, topics=3, topk=3)
    names = catalog.build(spark, str(source), str(tmp_path / "out"), config)
    recs = spark.sql("SELECT * FROM v_recs_equal").collect()
    assert recs and len(recs[0].__fields__) == 34 and all(r["src_work_id"] != r["rec_work_id"] and r["rank_variant"] <= 3 for r in recs)
    for n in names:
        tables.drop(spark, n)
    query = stream.write(stream.valid_books(spark, str(source), 1), str(tmp_path / "books"), str(tmp_path / "check"))
    query.awaitTermination(120)
    batch = spark.read.parquet(str(tmp_path / "out/books"))
    assert sorted(r["book_id"] for r in spark.read.parquet(str(tmp_path / "books")).collect()) == sorted(r["book_id"] for r in batch.collect())


def test_first_generation(spark):
    books = ingest.books(ingest.validate(jsonl.parse(spark.createDataFrame([(x,) for x in book_lines(40)], "value string"))).where("reject_reason is null"))
    shelves = spark.createDataFrame([(i, s, 2) for i in range(40) for s in ("Fantasy", "hugo award")], "book_id long, shelf string, count long")
    found, text_ = first_generation.candidates(books, shelves, k=4, min_df=2)
    rows = found.collect()
    assert rows and all(r["book_id"] != r["neighbor_book_id"] and r["rank_tfidf"] <= 4 and r["genre_overlap"] == 1.0 and r["neighbor_badges_top"] == "hugo award" for r in rows)
    vecs = first_generation.lda_vectors(text_, 3, 20)
    scored = first_generation.add_topic_score(found, vecs.where("id < 20"), "sim_lda")
    assert scored.count() == len(rows) and scored.where("neighbor_book_id >= 20 and sim_lda <> 0").isEmpty()
    first_generation.publish_serving(books, found, materialize=False)
    assert spark.sql("SELECT * FROM v_candidates JOIN v_books USING (book_id)").count() == len(rows)


def test_reports(spark):
    assert [report.duration(s) for s in (5, 65, 3725)] == ["5s", "1m 5s", "1h 2m 5s"]
    out = report.report(spark.createDataFrame([(i, "x" * i) for i in range(300)], "id long, t string"), "id", "t", 2, 10, 3)
    assert [r["id"] for r in out["later"].collect()] == [10, 11] and out["sample"].count() == 3
    assert [r["length"] for r in out["lengths"].collect()][-1] == 299 and max(len(r["t"]) for r in out["sample"].collect()) <= 200
