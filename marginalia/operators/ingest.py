"""Validation of raw records with one reason per rejected record, and their flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import description_or_null, is_blank, page_bucket, rating_map, to_double, to_long, year_of_either


def _is_list(name: str) -> Column:
    return F.coalesce(F.expr(f"schema_of_variant({name}) like 'ARRAY%'"), F.lit(False))


def _elements(name: str) -> Column:
    """Elements of a variant list; null if it is no list."""
    return F.when(_is_list(name), F.expr(f"try_variant_get({name}, '$', 'array<variant>')"))


#: Of a list element that is an object: its id (author_id, or id where that is null, empty or zero) and its name.
#: Each field is taken out of the element once.
_AUTHOR = """
transform(
  transform({0}, (e, i) -> struct(
    i as at,
    coalesce(schema_of_variant(e) like 'OBJECT%', false) as object,
    schema_of_variant(try_variant_get(e, '$.author_id', 'variant')) as kind,
    try_variant_get(e, '$.author_id', 'string') as own,
    try_variant_get(e, '$.id', 'string') as other,
    try_variant_get(e, '$.name', 'string') as name)),
  x -> named_struct(
    'at', x.at,
    'object', x.object,
    'id', case
      when x.kind = 'STRING' and x.own <> '' then x.own
      when x.kind not in ('STRING', 'VOID') and coalesce(try_cast(x.own as double) <> 0, x.own <> 'false') then x.own
      else x.other end,
    'name', x.name))
"""


def with_lists(records: DataFrame, where: Column | None = None) -> DataFrame:
    """``records`` with author_list and shelf_list, arrays of structs (null where the field is no list, or not ``where``)."""
    shelf = "transform(_s, e -> named_struct('object', coalesce(schema_of_variant(e) like 'OBJECT%', false), 'name', try_variant_get(e, '$.name', 'string'), 'count', try_cast(try_variant_get(e, '$.count', 'string') as bigint)))"
    # Generators keep the lists from being computed again in each rule that reads them.
    both = [_elements(c) if where is None else F.when(where, _elements(c)) for c in ("authors", "shelves")]
    df = records.select("*", F.inline(F.array(F.struct(both[0].alias("_a"), both[1].alias("_s")))))
    both = F.struct(F.expr(_AUTHOR.format("_a")).alias("author_list"), F.expr(shelf).alias("shelf_list"))
    return df.select(*[c for c in df.columns if c not in ("_a", "_s")], F.inline(F.array(both)))


def first_author(authors: Column) -> Column:
    """The first object with an id and a name; null without one."""
    return F.try_element_at(F.filter(authors, lambda a: a["object"] & ~is_blank(a["id"]) & ~is_blank(a["name"])), F.lit(1))


def _first(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for reason, failed in reversed(rules):
        out = F.when(failed, reason).otherwise(out)
    return out


def field_reason() -> Column:
    """The first rule on a record's plain fields that it fails; null if it passes all of them."""
    n, rating, pages = to_long(F.col("ratings_count")), to_double(F.col("average_rating")), to_long(F.col("num_pages"))
    return _first([
        ("missing_id", is_blank(F.col("id"))),
        ("missing_title", is_blank(F.col("title"))),
        ("missing_description", is_blank(F.col("description"))),
        ("missing_isbn", is_blank(F.col("isbn"))),
        ("missing_isbn13", is_blank(F.col("isbn13"))),
        ("language_not_eng", ~F.col("language").eqNullSafe("eng")),
        ("missing_publication_date", is_blank(F.col("publication_date"))),
        ("missing_original_publication_date", is_blank(F.col("original_publication_date"))),
        ("missing_publisher", is_blank(F.col("publisher"))),
        ("missing_rating_dist", is_blank(F.col("rating_dist"))),
        ("missing_ratings_count", n.isNull()),
        ("ratings_count_le_1", n <= 1),
        ("missing_average_rating", rating.isNull()),
        ("avg_rating_0_and_low_ratings", (rating == 0) & (n <= 1)),
        ("missing_num_pages", pages.isNull()),
        ("num_pages_le_0", pages <= 0),
    ])


def list_reason() -> Column:
    """The first rule on its lists that a record (see ``with_lists``) fails; null if it passes all of them."""
    author = first_author(F.col("author_list"))
    return _first([
        ("shelves_not_list", F.col("shelf_list").isNull()),
        ("shelves_empty", F.size("shelf_list") == 0),
        ("missing_author_id_or_name", (is_blank(F.col("author_id")) | is_blank(F.col("author_name"))) & author.isNull()),
    ])


def validate(records: DataFrame) -> DataFrame:
    """``records`` with reject_reason, the first rule that each fails, null if it passes all, and with its lists.

    Lists are taken apart only for records whose plain fields pass, as no later rule or table looks at the others; there
    they are null.
    """
    # As a generator's output the reason is found once, not once for each list that waits for it.
    known = records.select("*", F.inline(F.array(F.struct(field_reason().alias("_reason")))))
    listed = with_lists(known, F.col("_reason").isNull())
    return listed.withColumn("reject_reason", F.coalesce("_reason", list_reason())).drop("_reason")


def reject_histogram(validated: DataFrame, most: int = 20) -> DataFrame:
    counts = validated.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "reject_reason").limit(most)


def keep_rate(validated: DataFrame) -> DataFrame:
    seen, kept = F.count("*"), F.count_if(F.col("reject_reason").isNull())
    return validated.agg(seen.alias("seen"), kept.alias("kept"), (kept / F.nullif(seen, F.lit(0))).alias("keep_rate"))


def books(kept: DataFrame, full_entities: bool = True) -> DataFrame:
    """One flat row per record."""
    long = {c: to_long(F.col(c)) for c in ("work_id", "author_id", "ratings_count", "text_reviews_count", "series_id", "series_position")}
    pages, stars = to_long(F.col("num_pages")), rating_map(F.col("rating_dist"))
    return kept.select("*", F.inline(F.array(stars))).select(
        to_long(F.col("id")).alias("book_id"), long["work_id"].alias("work_id"), "title", long["author_id"].alias("author_id"), "author_name",
        "language", "isbn", "isbn13", "publisher", "publication_date", "original_publication_date",
        year_of_either(F.col("publication_date"), F.col("original_publication_date")).cast("bigint").alias("publication_year"),
        pages.alias("num_pages"), page_bucket(pages).alias("page_bucket"), to_double(F.col("average_rating")).alias("average_rating"),
        long["ratings_count"].alias("ratings_count"), long["text_reviews_count"].alias("text_reviews_count"), "rating_dist",
        "rating_5", "rating_4", "rating_3", "rating_2", "rating_1", "rating_total",
        F.col("description").alias("description_raw"), description_or_null(F.col("description"), full_entities).alias("description"),
        "format", "edition_information", "image_url", long["series_id"].alias("series_id"), "series_name", long["series_position"].alias("series_position"),
    )


def book_authors(kept: DataFrame) -> DataFrame:
    """(book_id, author_id, author_order, author_name); the top-level author only where the list is absent or empty."""
    own = F.array(F.struct(F.lit(0).alias("at"), F.lit(True).alias("object"), F.col("author_id").alias("id"), F.col("author_name").alias("name")))
    listed = F.when(F.size(F.coalesce("author_list", F.array().cast(kept.schema["author_list"].dataType))) > 0, F.col("author_list")).otherwise(own)
    rows = kept.select(to_long(F.col("id")).alias("book_id"), F.explode(listed).alias("a"))
    author = to_long(F.col("a.id"))
    rows = rows.where(F.col("a.object") & F.col("book_id").isNotNull() & author.isNotNull() & ~is_blank(F.col("a.name")))
    return rows.select("book_id", author.alias("author_id"), F.col("a.at").cast("bigint").alias("author_order"), F.col("a.name").alias("author_name"))


def book_shelves(kept: DataFrame) -> DataFrame:
    """(book_id, shelf, count); names are kept as they are, counts may be null."""
    rows = kept.select(to_long(F.col("id")).alias("book_id"), F.explode("shelf_list").alias("s"))
    rows = rows.where(F.col("s.object") & F.col("book_id").isNotNull() & ~is_blank(F.col("s.name")))
    return rows.select("book_id", F.col("s.name").alias("shelf"), F.col("s.count").alias("count"))
