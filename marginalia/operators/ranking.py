"""Pair scores, top lists by several criteria, serving views and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sets import jaccard, token_set
from ..functions.vectors import dot, unit
from ..sources.tables import publish
from .works import top_per


def add_similarity(pairs: DataFrame, vectors: DataFrame, name: str, a: str = "work_id", b: str = "neighbor_work_id", missing: str = "error") -> DataFrame:
    """``pairs`` with the cosine of the two rows' vectors (id, vec) as ``name``.

    ``missing``: a pair whose vector is absent is an 'error' when the result is computed, or counts as 'zero'.
    """
    units = vectors.select("id", unit(F.col("vec")).alias("u"))
    left = units.select(F.col("id").alias(a), F.col("u").alias("_a"))
    right = units.select(F.col("id").alias(b), F.col("u").alias("_b"))
    met = pairs.join(left, a, "left").join(right, b, "left")
    score = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), dot(F.col("_a"), F.col("_b")))
    if missing == "error":
        text = F.concat(F.lit("no vector for "), F.col(a).cast("string"), F.lit(" or "), F.col(b).cast("string"))
        score = F.coalesce(score, F.raise_error(text).cast("double"))
    else:
        score = F.coalesce(score, F.lit(0.0))
    return met.select(*[F.col(c) for c in pairs.columns], score.cast("float").alias(name))


def equal_score(*names: str) -> Column:
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n).cast("double")
    return total / len(names)


#: Order of each list of candidates; ties end at the neighbour's id.
VARIANTS = {
    "tfidf": [("sim_tfidf", True), ("rank_tfidf", False)],
    "lda": [("sim_lda", True), ("sim_tfidf", True)],
    "nmf": [("sim_nmf", True), ("sim_tfidf", True)],
    "equal": [("score_eq", True), ("sim_tfidf", True)],
}


def candidates(pairs: DataFrame, variant: str, k: int = 50) -> DataFrame:
    """The first ``k`` neighbours of each work in the variant's order, with rank_variant."""
    if variant == "equal":
        pairs = pairs.withColumn("score_eq", equal_score("sim_tfidf", "sim_lda", "sim_nmf"))
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in VARIANTS[variant]]
    return top_per(pairs, "work_id", [*order, F.asc_nulls_last("neighbor_work_id")], k, rank="rank_variant")


DETAILS = [
    "title", "author_name", "publisher", "publication_date", "num_pages", "average_rating", "ratings_count",
    "rating_dist", "genres_top", "badges_top", "series_id", "series_name", "description_clean",
]


def recommendations(found: DataFrame, works: DataFrame, details: list[str] | None = None) -> DataFrame:
    """Candidates with the details of both works, prefixed src_ and rec_; score_eq is null where it is absent."""
    details = details or DETAILS

    def side(prefix: str) -> DataFrame:
        return works.select(F.col("work_id").alias(f"{prefix}_work_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in details])

    score = F.col("score_eq").cast("double") if "score_eq" in found.columns else F.lit(None).cast("double")
    pairs = found.select(
        F.col("work_id").alias("src_work_id"), F.col("neighbor_work_id").alias("rec_work_id"), "sim_tfidf", "rank_tfidf", "sim_lda", "sim_nmf", score.alias("score_eq"), "rank_variant",
    ).where("src_work_id <> rec_work_id")
    return pairs.join(side("src"), "src_work_id").join(side("rec"), "rec_work_id")


def publish_serving(works: DataFrame, pairs: DataFrame, details: list[str] | None = None, k: int = 50, materialize: bool = False) -> list[str]:
    """v_works, and v_candidates_* and v_recs_* of each variant: views, or tables with ``materialize``."""
    publish(works, "v_works", materialize)
    names = ["v_works"]
    for variant in VARIANTS:
        found = candidates(pairs, variant, k)
        publish(found, f"v_candidates_{variant}", materialize)
        publish(recommendations(found, works, details), f"v_recs_{variant}", materialize)
        names += [f"v_candidates_{variant}", f"v_recs_{variant}"]
    return names


def first_generation_candidates(pairs: DataFrame, books: DataFrame) -> DataFrame:
    """Per pair the rank by similarity, details of both books and the overlap of their genres.

    A book listed twice counts once (its first row by title); missing texts are empty, missing numbers 0.
    """
    one = top_per(books, "book_id", [F.asc_nulls_last("title")], 1)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "author_name", "genres_top", "badges_top")]
    one = one.select("book_id", *text, F.coalesce("average_rating", F.lit(0.0)).alias("average_rating"), F.coalesce("ratings_count", F.lit(0)).alias("ratings_count"))
    left = one.select("book_id", F.col("title").alias("book_title"), F.col("genres_top").alias("_g"))
    right = one.select(F.col("book_id").alias("neighbor_book_id"), *[F.col(c).alias(f"neighbor_{c}") for c in one.columns[1:]])
    ranked = top_per(pairs, "book_id", [F.desc_nulls_last("sim_tfidf"), F.asc_nulls_last("neighbor_book_id")], 2**31 - 1, rank="rank_tfidf")
    met = ranked.join(left, "book_id", "left").join(right, "neighbor_book_id", "left")
    return met.select(
        "book_id", F.coalesce("book_title", F.lit("")).alias("book_title"), "neighbor_book_id", F.coalesce("neighbor_title", F.lit("")).alias("neighbor_title"),
        F.coalesce("neighbor_author_name", F.lit("")).alias("neighbor_author"), "sim_tfidf", F.col("rank_tfidf").cast("long").alias("rank_tfidf"),
        jaccard(token_set(F.col("_g")), token_set(F.col("neighbor_genres_top"))).alias("genre_overlap"),
        F.coalesce("neighbor_average_rating", F.lit(0.0)).alias("neighbor_average_rating"), F.coalesce("neighbor_ratings_count", F.lit(0)).cast("long").alias("neighbor_ratings_count"),
        F.coalesce("neighbor_genres_top", F.lit("")).alias("neighbor_genres_top"), F.coalesce("neighbor_badges_top", F.lit("")).alias("neighbor_badges_top"),
    )


def candidate_ids(pairs: DataFrame, a: str = "book_id", b: str = "neighbor_book_id") -> DataFrame:
    """All ids of either column once, in order."""
    return pairs.select(F.col(a).alias("id")).union(pairs.select(F.col(b).alias("id"))).where("id is not null").distinct().orderBy("id")


def evaluate(found: DataFrame, k: int = 10) -> DataFrame:
    """One row of proxies over each source's first ``k``: genre overlap, distinct authors, popularity, pairs.

    ``found`` has book_id, sim_tfidf, neighbor_book_id, neighbor_author, genre_overlap, neighbor_ratings_count.
    """
    top = top_per(found, "book_id", [F.desc_nulls_last("sim_tfidf"), F.asc_nulls_last("neighbor_book_id")], k)
    authors = top.groupBy("book_id").agg(F.count_distinct(F.nullif("neighbor_author", F.lit(""))).alias("n"))
    a = authors.agg(F.avg("n").alias("unique_authors_mean"), F.median("n").alias("unique_authors_median"))
    p = top.agg(
        F.avg("genre_overlap").alias("genre_overlap_mean"), F.median("genre_overlap").alias("genre_overlap_median"), F.percentile("genre_overlap", F.lit(0.9)).alias("genre_overlap_p90"),
        F.median("neighbor_ratings_count").alias("popularity_median"), F.percentile("neighbor_ratings_count", F.lit(0.9)).alias("popularity_p90"),
        F.percentile("neighbor_ratings_count", F.lit(0.99)).alias("popularity_p99"), F.count("*").alias("n_pairs"),
    )
    return p.crossJoin(a)  # one row each


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in random order, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)


def sample_lists(found: DataFrame, n: int = 20, k: int = 10, seed: int = 42) -> DataFrame:
    """Recommendation lists of ``n`` random sources, one row per pair with its place."""
    some = sample_exact(found.select("book_id").distinct(), n, "book_id", seed)
    order = [F.desc_nulls_last("sim_tfidf"), F.asc_nulls_last("neighbor_book_id")]
    return top_per(found.join(some, "book_id", "left_semi"), "book_id", order, k, rank="place")


QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def length_quantiles(df: DataFrame, text: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(q, length): exact quantiles of text lengths with linear interpolation, cut to whole numbers."""
    q = df.agg(F.percentile(F.length(F.coalesce(text, F.lit(""))), F.array(*map(F.lit, at))).alias("v"))
    return q.select(F.posexplode("v").alias("i", "x")).select(F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("q"), F.col("x").cast("long").alias("length"))


def inspect(df: DataFrame, key: str, columns: dict[str, str], head: int = 5, at: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first rows, and as many from place ``at``, in order of ``key``; absent columns are null."""
    from ..sources.tables import project_existing

    rows = project_existing(df, columns).orderBy(key)
    return rows.limit(head), rows.offset(at).limit(head)
