"""From JSON lines to recommendations, as one plan; ``python -m marginalia.plans.catalog IN OUT`` writes it."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import cap, description
from ..functions.text import terms
from ..operators import ingest, ranking, similarity, topics, works
from ..sources import jsonl, tables


@dataclass
class Config:
    max_seen: int | None = None
    min_count: int = 1
    max_tags: int = 25
    min_length: int = 80
    cap: int = 4000
    k: int = 100
    features: int = 80_000
    min_df: int = 10
    max_df: float = 0.6
    ngrams: int = 2
    topics: int = 50
    lda_docs: int | None = 100_000
    lda_features: int = 50_000
    topk: int = 50


def books_and_tags(spark: SparkSession, path: str, config: Config) -> dict[str, DataFrame]:
    kept = ingest.validate(jsonl.read(spark, path, most=config.max_seen)).where("reject_reason is null")
    books, shelves = ingest.books(kept), ingest.book_shelves(kept)
    tags = works.tag_sums(shelves, books, config.min_count)
    return {
        "books": books, "book_authors": ingest.book_authors(kept), "book_shelves": shelves,
        "work_genres": works.top_tags(tags, "genre", config.max_tags), "work_badges": works.top_tags(tags, "badge", config.max_tags),
    }


def work_texts(catalog: DataFrame, config: Config) -> DataFrame:
    """Works with a long enough clean description, which ``description_model`` caps."""
    text = catalog.where("has_desc80 = 1").withColumn("description_clean", description(F.coalesce("description", F.lit(""))))
    text = text.withColumn("description_len", F.length("description_clean").cast("bigint")).where(F.col("description_len") >= config.min_length)
    return text.withColumn("description_model", cap(F.col("description_clean"), config.cap))


def neighbors(text: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, weights, vocabulary) of the works' texts."""
    docs = text.where("description_model is not null").select(F.col("work_id").alias("id"), "description_model")
    counts = similarity.term_counts(docs, terms(F.col("description_model"), config.ngrams))
    n = docs.count()
    vocab = similarity.vocabulary(counts, n, config.min_df, config.max_df, config.features)
    weights = similarity.tfidf(counts, vocab, n)
    pairs = similarity.knn_blocks(weights, config.k)
    pairs = pairs.select(F.col("id").alias("work_id"), F.col("neighbor_id").alias("neighbor_work_id"), F.col("sim").cast("float").alias("sim_tfidf"), F.col("rank").cast("int").alias("rank_tfidf"))
    return pairs, weights, vocab


def build(spark: SparkSession, source: str, out: str, config: Config | None = None) -> list[str]:
    """Writes every table under ``out`` and publishes the serving views; returns their names."""
    config = config or Config()

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.write_parquet(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    made = {name: keep(df, name) for name, df in books_and_tags(spark, source, config).items()}
    catalog = keep(works.work_catalog(made["books"], made["work_genres"], made["work_badges"], config.max_tags, config.min_length), "work_books_catalog")
    text = keep(work_texts(catalog, config), "work_books_text")
    pairs, weights, vocab = neighbors(text, config)
    weights, vocab = keep(weights, "tfidf_weights"), keep(vocab, "tfidf_vocabulary")
    pairs = keep(pairs, "neighbors_work_tfidf")
    docs = text.select(F.col("work_id").alias("id"), F.col("description_model").alias("text"))
    model, vectorizer, lda = topics.lda(docs, topics=config.topics, fit_docs=config.lda_docs, features=config.lda_features, min_df=config.min_df, max_df=config.max_df)
    lda = keep(lda, "topics_lda")
    keep(topics.lda_keywords(model, vectorizer), "keywords_lda")
    topics.save_lda(model, vectorizer, f"{out}/model_lda")
    nmf = topics.Nmf(config.topics).fit(weights, vocab)
    vectors = keep(nmf.transform(weights, docs), "topics_nmf")
    keep(nmf.keywords(spark), "keywords_nmf")
    nmf.save(spark, f"{out}/model_nmf")
    scored = ranking.add_similarity(ranking.add_similarity(pairs, lda, "sim_lda"), vectors, "sim_nmf")
    return ranking.publish_serving(text, keep(scored, "pairs_scored"), k=config.topk)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("source")
    args.add_argument("out")
    for f in fields(Config):
        kind = float if isinstance(f.default, float) else int
        args.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
    given = vars(args.parse_args())
    build(SparkSession.builder.getOrCreate(), given.pop("source"), given.pop("out"), Config(**given))


if __name__ == "__main__":
    main()
