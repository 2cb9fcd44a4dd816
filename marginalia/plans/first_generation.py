"""The older, edition-level pipeline: books and shelves to candidates with topic scores, and their serving views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import cap, clean_first_generation
from ..functions.text import terms
from ..operators import ranking, similarity, topics, works
from ..sources.tables import project_existing, publish


def book_texts(books: DataFrame, least: int = 80, most: int = 4000, keep_raw: bool = False) -> DataFrame:
    """Cleaned descriptions of at least ``least`` characters, and their capped form; absent columns are null."""
    kept = {"book_id": "bigint", "title": "string", "genres_top": "string", "description": "string", **({"description_raw": "string"} if keep_raw else {})}
    text = project_existing(books, kept).withColumn("description_clean", clean_first_generation(F.col("description"))).drop("description")
    text = text.withColumn("description_len", F.length("description_clean").cast("int")).where(F.col("description_len") >= least)
    text = text.withColumn("description_model", cap(F.col("description_clean"), most))
    return text.withColumn("description_model_len", F.length("description_model").cast("bigint"))


def candidates(books: DataFrame, shelves: DataFrame, k: int = 20, top_tags: int = 15, features: int = 80_000, min_df: int = 10, max_df: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(candidates, texts): the nearest books by text with details and genre overlap."""
    tagged = works.merge_tags_first_generation(books, works.book_tags_first_generation(shelves, top_tags), top_tags)
    text = book_texts(tagged)
    docs = text.select(F.col("book_id").alias("id"), F.col("description_model").alias("text"))
    counts = similarity.term_counts(docs, terms(F.col("text"), 2, lowercase=True))
    n = docs.count()
    weights = similarity.tfidf(counts, similarity.vocabulary(counts, n, min_df, max_df, features), n)
    pairs = similarity.knn_blocks(weights, k).select(F.col("id").alias("book_id"), F.col("neighbor_id").alias("neighbor_book_id"), F.col("sim").alias("sim_tfidf"))
    return ranking.first_generation_candidates(pairs, tagged), text


def add_topic_score(found: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """Cosine of topic vectors per pair; books without a vector score 0."""
    return ranking.add_similarity(found, vectors, name, "book_id", "neighbor_book_id", missing="zero")


def lda_vectors(text: DataFrame, n_topics: int = 50, fit_docs: int = 100_000, online: bool = False, seed: int = 42) -> DataFrame:
    """Topic vectors of all texts from a model of a random sample, the same each time."""
    docs = text.select(F.col("book_id").alias("id"), F.col("description_model").alias("text"))
    return topics.lda(docs, topics=n_topics, fit_docs=fit_docs, features=80_000, online=online, seed=seed, fit_seed=seed)[2]


def publish_serving(books: DataFrame, found: DataFrame, materialize: bool = True) -> None:
    publish(books, "v_books", materialize)
    publish(found, "v_candidates", materialize)
