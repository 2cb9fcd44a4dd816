"""Tags per work, representative rows, and the catalog of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import kind, normal_name


#: Parts that the rows of one name are dealt to.
PARTS = 16


def with_kinds(rows: DataFrame, names: DataFrame, key: str = "work_id", generation: int = 2) -> DataFrame:
    """``rows`` with shelf and kind of their raw name, found once for each of ``names``.

    The rows of a name are dealt over ``PARTS``, since a few names hold most rows; where the names turn out to be
    few the join becomes a broadcast at run time.
    """
    known = names.withColumn("shelf", normal_name(F.col("raw"), generation))
    known = known.withColumn("kind", kind(F.col("shelf"), generation)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
    return dealt.join(known, ["raw", "part"]).drop("part")


def tag_sums(shelves: DataFrame, editions: DataFrame, min_count: int = 1, reaggregate: bool = False) -> DataFrame:
    """(work_id, shelf, count, kind) of tags that are kept.

    Counts are summed by the trimmed raw name and filtered by ``min_count`` before names are made normal, so two
    spellings of one tag stay two rows; ``reaggregate`` sums them once more.
    """
    named = shelves.select("book_id", F.trim("shelf").alias("raw"), "count").where("raw is not null and raw <> ''")
    joined = named.join(editions.select("book_id", "work_id").where("work_id is not null"), "book_id")
    sums = joined.groupBy("work_id", "raw").agg(F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("count"))
    sums = with_kinds(sums.where(F.col("count") >= min_count), named.select("raw").distinct()).where("kind <> 'drop'")
    if reaggregate:
        sums = sums.groupBy("work_id", "shelf", "kind").agg(F.sum("count").alias("count"))
    return sums.select("work_id", "shelf", "count", "kind")


def top_per(df: DataFrame, key: str | list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key; Spark cuts each partition to ``n`` before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n)
    return out.withColumnRenamed("_n", rank) if rank else out.drop("_n")


def top_tags(tags: DataFrame, which: str, n: int = 25) -> DataFrame:
    rows = tags.where(F.col("kind") == which).select("work_id", "shelf", "count")
    return top_per(rows, "work_id", [F.desc_nulls_last("count"), F.asc_nulls_last("shelf")], n)


def joined_tags(tags: DataFrame, name: str, n: int = 25) -> DataFrame:
    """(work_id, name): up to ``n`` tags joined by | in order of count, then name."""
    rows = top_per(tags, "work_id", [F.desc_nulls_last("count"), F.asc_nulls_last("shelf")], n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "shelf")))
    return rows.groupBy("work_id").agg(F.array_join(F.transform(listed, lambda x: x["shelf"]), "|").alias(name))


def packed_score(has_description: Column, ratings: Column, average: Column) -> Column:
    """Description, then ratings, then average rating in one number; the average rounds half to even."""
    return (has_description * F.lit(10**15) + F.coalesce(ratings, F.lit(0)) * F.lit(10**6) + F.rint(F.coalesce(average, F.lit(0.0)) * 1000).cast("bigint")).cast("bigint")


def best_of(column: str, score: Column, tie: Column) -> Column:
    """The value of the row with the best score among rows where it isn't null; ties go to the smaller ``tie``."""
    value = F.col(column)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(score, -tie)))


def representatives(editions: DataFrame, columns: list[str], key: str = "work_id", tie: str = "book_id", score: str = "score", maxima: list[str] | None = None) -> DataFrame:
    """Per key the best non-null value of each column, each on its own, and plain maxima."""
    aggs = [best_of(c, F.col(score), F.col(tie)).alias(c) for c in columns]
    return editions.groupBy(key).agg(best_of(tie, F.col(score), F.col(tie)).alias(f"rep_{tie}"), *aggs, *[F.max(c).alias(c) for c in maxima or []])


def combined_tags(first: Column, second: Column) -> Column:
    return F.nullif(F.concat_ws("|", first, second), F.lit(""))


def work_catalog(books: DataFrame, genres: DataFrame, badges: DataFrame, top_n: int = 25, min_length: int = 80) -> DataFrame:
    """One row per work: composite best columns, plain maxima of ratings and description flag, tag strings."""
    flagged = books.where("work_id is not null").withColumn("has_desc80", F.when(F.length(F.trim("description")) >= min_length, 1).otherwise(0))
    flagged = flagged.withColumn("score", packed_score(F.col("has_desc80"), F.col("ratings_count"), F.col("average_rating")))
    own = [c for c in books.columns if c not in ("book_id", "work_id", "ratings_count", "page_bucket")]
    rep = representatives(flagged, own, maxima=["ratings_count", "has_desc80"])
    out = rep.join(joined_tags(genres, "genres_top", top_n), "work_id", "left").join(joined_tags(badges, "badges_top", top_n), "work_id", "left")
    return out.withColumn("shelves_combined", combined_tags(F.col("genres_top"), F.col("badges_top")))


def book_tags_first_generation(shelves: DataFrame, top_n: int = 15) -> DataFrame:
    """(book_id, shelf, weight, kind): per book and normal name the largest count, at least 0; the top of each kind."""
    raw = shelves.select("book_id", F.col("shelf").alias("raw"), F.greatest(F.coalesce("count", F.lit(0)), F.lit(0)).cast("bigint").alias("count"))
    rows = with_kinds(raw, raw.select("raw").distinct(), "book_id", 1).where("shelf <> '' and kind <> 'drop'")
    rows = rows.groupBy("book_id", "shelf", "kind").agg(F.max("count").alias("weight")).select("book_id", "shelf", "weight", "kind")
    return top_per(rows, ["book_id", "kind"], [F.desc("weight"), F.asc("shelf")], top_n)


def merge_tags_first_generation(books: DataFrame, tags: DataFrame, n: int = 15, weights: bool = False) -> DataFrame:
    """``books`` with genres_top and badges_top (empty where there are none), and name:weight pairs if asked for."""

    def listed(which: str, pair: bool) -> Column:
        x = F.array_sort(F.collect_list(F.when(F.col("kind") == which, F.struct((-F.col("weight")).alias("w"), "shelf"))))
        return F.array_join(F.transform(x, lambda x: F.concat(x["shelf"], F.lit(":"), (-x["w"]).cast("string")) if pair else x["shelf"]), "|")

    wanted = {"genres_top": ("genre", False), "badges_top": ("badge", False)} | ({"genres_top_weights": ("genre", True)} if weights else {})
    top = top_per(tags.where(F.col("kind").isin("genre", "badge")), ["book_id", "kind"], [F.desc("weight"), F.asc("shelf")], n)
    # All lists are made in one pass over the tags.
    made = top.groupBy("book_id").agg(*[listed(*how).alias(f"_{name}") for name, how in wanted.items()])
    out = books.join(made, "book_id", "left")
    return out.select(*books.columns, *[F.coalesce(f"_{name}", F.lit("")).alias(name) for name in wanted])
