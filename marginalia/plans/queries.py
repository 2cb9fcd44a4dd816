"""The driver's queries over the synthetic tables, each beside its SQL form for another engine.

Every query runs over its whole table. Ranks, counts and lengths are longs, and floating results are rounded to
six places, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, tags, text, vectors
from ..operators import ingest, ranking, similarity, topics, works
from ..sources import jsonl, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return tables.scan(spark, f"{sf}/{name}.parquet", list(columns) or None)


# --- raw records, validation and flat tables ---------------------------------------------------------------------


def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines made of orders, with every kind of fault that can be a record's first one (a rating of 0 with at
    most one vote never is: the rule before it takes all records with so few votes)."""
    k = F.col("o_orderkey")

    def unless(every: int, value, other=None):
        return F.when(k % every == 0, F.lit(other)).otherwise(value)

    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    record = F.struct(
        unless(59, k.cast("string"), " ").alias("id"), (k % 97).alias("work_id"), unless(11, F.col("o_orderpriority"), "  ").alias("title"),
        unless(61, F.concat(F.lit("<p>A &amp; "), F.col("o_orderpriority"), F.lit("</p>")), "\t").alias("description"), unless(13, F.lit("x")).alias("isbn"), unless(17, F.lit("y"), "").alias("isbn13"),
        unless(5, F.lit("eng"), "en").alias("language"), F.when(k % 67 != 0, unless(43, day, "soon")).alias("publication_date"), unless(19, day).alias("original_publication_date"),
        unless(23, F.lit("p"), " ").alias("publisher"), unless(71, F.concat(F.lit("5:"), k.cast("string"), F.lit("|4:2|4:x|total:"), (k + 2).cast("string"))).alias("rating_dist"),
        unless(29, (k % 9).cast("string"), "abc").alias("ratings_count"), unless(53, F.round(F.col("o_totalprice") / 100000, 2)).alias("average_rating"),
        unless(73, (k % 700 - 5).cast("string"), "many").alias("num_pages"), unless(41, (k % 31 + 1).cast("string")).alias("author_id"), F.lit("Top").alias("author_name"),
        F.when(k % 3 == 0, F.array(F.struct((k % 7).cast("string").alias("id"), F.lit("Ann").alias("name")), F.struct(F.lit("8").alias("id"), unless(2, F.lit("Bob")).alias("name")))).alias("authors"),
        F.when(k % 37 == 0, F.array().cast("array<struct<name:string,count:bigint>>")).when(k % 31 != 0, F.array(F.struct(F.col("o_orderpriority").alias("name"), (k % 4).alias("count")), F.struct(F.lit(" ").alias("name"), F.lit(1).cast("bigint").alias("count")))).alias("shelves"),
    )
    lines = tables.spread(table(spark, sf, "orders")).select(F.to_json(record).alias("value"))
    return lines.union(spark.createDataFrame([("",), ("[1]",), ('[{"id": "1"}]',), ("   ",)], "value string"))


_RAW = """raw AS (SELECT o_orderkey AS k, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS d, o_totalprice AS t FROM orders),
reasons AS (SELECT *, CASE WHEN k % 59 = 0 THEN 'missing_id' WHEN k % 11 = 0 THEN 'missing_title' WHEN k % 61 = 0 THEN 'missing_description' WHEN k % 13 = 0 THEN 'missing_isbn' WHEN k % 17 = 0 THEN 'missing_isbn13'
  WHEN k % 5 = 0 THEN 'language_not_eng' WHEN k % 67 = 0 THEN 'missing_publication_date' WHEN k % 19 = 0 THEN 'missing_original_publication_date' WHEN k % 23 = 0 THEN 'missing_publisher' WHEN k % 71 = 0 THEN 'missing_rating_dist'
  WHEN k % 29 = 0 THEN 'missing_ratings_count' WHEN k % 9 <= 1 THEN 'ratings_count_le_1' WHEN k % 53 = 0 THEN 'missing_average_rating'
  WHEN k % 73 = 0 THEN 'missing_num_pages' WHEN k % 700 - 5 <= 0 THEN 'num_pages_le_0' WHEN k % 31 = 0 AND k % 37 <> 0 THEN 'shelves_not_list' WHEN k % 37 = 0 THEN 'shelves_empty'
  WHEN k % 41 = 0 AND k % 3 <> 0 THEN 'missing_author_id_or_name' END AS reject_reason FROM raw),
kept AS (SELECT * FROM reasons WHERE reject_reason IS NULL)"""


def validated(spark, sf):
    return ingest.validate(jsonl.parse(raw_records(spark, sf)))


@query(f"WITH {_RAW} SELECT reject_reason, count(*) AS n FROM reasons WHERE reject_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def reject_reasons(spark, sf):
    return ingest.reject_histogram(validated(spark, sf))


@query(f"WITH {_RAW} SELECT count(*) AS seen, count(*) FILTER (reject_reason IS NULL) AS kept, round(count(*) FILTER (reject_reason IS NULL) / count(*), 6) AS keep_rate FROM reasons")
def validate_keep_rate(spark, sf):
    return ingest.keep_rate(validated(spark, sf)).withColumn("keep_rate", F.round("keep_rate", 6))


@query(f"""WITH {_RAW} SELECT k AS book_id, k % 97 AS work_id, p AS title, CASE WHEN k % 41 <> 0 THEN k % 31 + 1 END AS author_id,
  CAST(coalesce(TRY_CAST(nullif(regexp_extract(CASE WHEN k % 43 = 0 THEN 'soon' ELSE d END, '\\b(\\d{{4}})\\b', 1), '') AS INTEGER), TRY_CAST(regexp_extract(d, '\\b(\\d{{4}})\\b', 1) AS INTEGER)) AS BIGINT) AS publication_year,
  k % 700 - 5 AS num_pages, CASE WHEN k % 700 - 5 < 100 THEN 'short' WHEN k % 700 - 5 < 300 THEN 'medium' WHEN k % 700 - 5 < 600 THEN 'long' ELSE 'epic' END AS page_bucket,
  round(t / 100000, 2) AS average_rating, k % 9 AS ratings_count, k AS rating_5, CAST(2 AS BIGINT) AS rating_4, CAST(NULL AS BIGINT) AS rating_3, k + 2 AS rating_total, 'A & ' || p AS description FROM kept""")
def flatten_books(spark, sf):
    kept = validated(spark, sf).where("reject_reason is null")
    return ingest.books(kept, full_entities=False).select(
        "book_id", "work_id", "title", "author_id", "publication_year", "num_pages", "page_bucket", "average_rating",
        "ratings_count", "rating_5", "rating_4", "rating_3", "rating_total", "description",
    )


@query(f"""WITH {_RAW} SELECT k AS book_id, CAST(k % 7 AS BIGINT) AS author_id, CAST(0 AS BIGINT) AS author_order, 'Ann' AS author_name FROM kept WHERE k % 3 = 0
  UNION ALL SELECT k, 8, 1, 'Bob' FROM kept WHERE k % 3 = 0 AND k % 2 <> 0 UNION ALL SELECT k, k % 31 + 1, 0, 'Top' FROM kept WHERE k % 3 <> 0 AND k % 41 <> 0""")
def explode_authors(spark, sf):
    return ingest.book_authors(validated(spark, sf).where("reject_reason is null"))


@query(f"WITH {_RAW} SELECT k AS book_id, p AS shelf, k % 4 AS count FROM kept")
def explode_tags(spark, sf):
    return ingest.book_shelves(validated(spark, sf).where("reject_reason is null"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", clean.to_long(F.from_json("props", "k string")["k"]).alias("k"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, q + 1 AS rating_5, CASE WHEN n % 2 = 0 THEN q END AS rating_4, CAST(7 AS BIGINT) AS rating_3,
  CAST(NULL AS BIGINT) AS rating_2, CAST(NULL AS BIGINT) AS rating_1, q * 2 AS rating_total FROM d""")
def parse_map_string(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    four = F.when(F.col("l_linenumber") % 2 == 0, q.cast("string")).otherwise("x")
    dist = F.concat_ws("|", F.concat(F.lit("5:"), q.cast("string")), F.concat(F.lit(" 4:"), four), F.lit("3:7"), F.concat(F.lit("5:"), (q + 1).cast("string")), F.concat(F.lit("total:"), (q * 2).cast("string")), F.lit("9:1"), F.lit("12:4"))
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.inline(F.array(clean.rating_map(dist))))


@query("""SELECT o_orderkey, coalesce(nullif(TRY_CAST(nullif(regexp_extract(a, '\\b(\\d{4})\\b', 1), '') AS INTEGER), 0), TRY_CAST(nullif(regexp_extract(b, '\\b(\\d{4})\\b', 1), '') AS INTEGER)) AS y
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN '0000-01-01' WHEN 2 THEN 'May ' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS a,
  CASE WHEN o_orderkey % 3 = 0 THEN '1' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS b FROM orders)""")
def parse_year(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    a = F.when(k % 5 == 0, F.date_format(d, "yyyyMMdd")).when(k % 5 == 1, "0000-01-01").when(k % 5 == 2, F.concat(F.lit("May "), F.date_format(d, "yyyy"))).otherwise(F.date_format(d, "yyyy-MM-dd"))
    b = F.when(k % 3 == 0, F.concat(F.lit("1"), F.date_format(d, "yyyy"))).otherwise(F.date_format(d, "dd.MM.yyyy"))
    return table(spark, sf, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", clean.year_of_either(a, b).alias("y"))


@query("SELECT p_partkey, CASE WHEN p < 100 THEN 'short' WHEN p < 300 THEN 'medium' WHEN p < 600 THEN 'long' WHEN p IS NOT NULL THEN 'epic' END AS bucket FROM (SELECT p_partkey, nullif(p_size, 7) * 15 AS p FROM part)")
def bucketize(spark, sf):
    return table(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", clean.page_bucket(F.nullif("p_size", F.lit(7)) * 15).alias("bucket"))


# --- tags --------------------------------------------------------------------------------------------------------

_SUFFIX = ["", "", " To  Read", " award", " library", " Favorites", " 3 stars", " classics"]


def shelves(spark, sf):
    """Tags of lines: the part's name with an ending that makes some of them badges or noise."""
    parts = table(spark, sf, "part", "p_partkey", "p_name")
    name = F.concat(F.lit(" "), F.col("p_name"), F.get(F.array(*map(F.lit, _SUFFIX)), (F.col("p_partkey") % 8).cast("int")), F.lit(" "))
    named = parts.select(F.col("p_partkey").alias("l_partkey"), name.alias("shelf"))
    lines = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    count = F.when(F.col("l_quantity") > 3, F.col("l_quantity").cast("bigint"))
    return lines.join(named, "l_partkey").select(F.col("l_orderkey").alias("book_id"), "shelf", count.alias("count"))


def editions(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("book_id"), F.col("o_custkey").alias("work_id"))


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _kind_sql(generation: int) -> str:
    exact, drop, badge = (tags.DROP_EXACT_2, tags.DROP_PATTERNS_2, tags.BADGE_PATTERNS_2) if generation == 2 else (tags.DROP_EXACT_1, tags.DROP_PATTERNS_1, [*tags.ALWAYS_BADGE_1, *tags.BADGE_PATTERNS_1])
    return f"CASE WHEN s IN ({_quoted(exact)}) OR regexp_matches(s, '{tags.any_of(drop)}') THEN 'drop' WHEN regexp_matches(s, '{tags.any_of(badge)}') THEN 'badge' ELSE 'genre' END"


_SHELVES = f"""shelves AS (SELECT l_orderkey AS book_id, ' ' || p_name || ([{_quoted(_SUFFIX)}])[CAST(p_partkey % 8 AS INTEGER) + 1] || ' ' AS shelf,
  CASE WHEN l_quantity > 3 THEN CAST(l_quantity AS BIGINT) END AS count FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_TAGS = f"""{_SHELVES}, sums AS (SELECT o_custkey AS work_id, trim(shelf) AS raw, CAST(sum(coalesce(count, 0)) AS BIGINT) AS count FROM shelves JOIN orders ON o_orderkey = book_id GROUP BY 1, 2 HAVING sum(coalesce(count, 0)) >= 1),
named AS (SELECT work_id, regexp_replace(lower(raw), '\\s+', '-', 'g') AS s, count FROM sums), tags AS (SELECT * FROM (SELECT work_id, s AS shelf, count, {_kind_sql(2)} AS kind FROM named) WHERE kind <> 'drop')"""


def tag_rows(spark, sf):
    return works.tag_sums(shelves(spark, sf), editions(spark, sf))


@query(f"WITH {_TAGS} SELECT * FROM tags")
def tag_sum_having(spark, sf):
    return tag_rows(spark, sf)


@query(f"WITH {_SHELVES}, named AS (SELECT DISTINCT regexp_replace(lower(trim(shelf)), '\\s+', '-', 'g') AS s FROM shelves) SELECT s AS name, {_kind_sql(2)} AS kind FROM named")
def tag_classify(spark, sf):
    names = shelves(spark, sf).select(tags.normal_name(F.col("shelf")).alias("name")).distinct()
    return names.withColumn("kind", tags.kind(F.col("name")))


@query(f"WITH {_SHELVES}, named AS (SELECT DISTINCT regexp_replace(lower(trim(shelf)), '\\s+', ' ', 'g') AS s FROM shelves) SELECT s AS name, {_kind_sql(1)} AS kind FROM named")
def tag_classify_v1(spark, sf):
    names = shelves(spark, sf).select(tags.normal_name(F.col("shelf"), 1).alias("name")).distinct()
    return names.withColumn("kind", tags.kind(F.col("name"), 1))


_TOP = "row_number() OVER (PARTITION BY work_id ORDER BY count DESC NULLS LAST, shelf ASC)"


@query(f"WITH {_TAGS} SELECT work_id, shelf, count FROM tags WHERE kind = 'genre' QUALIFY {_TOP} <= 5")
def tag_topn(spark, sf):
    return works.top_tags(tag_rows(spark, sf), "genre", 5)


@query(f"WITH {_TAGS}, t AS (SELECT * FROM tags WHERE kind = 'genre' QUALIFY {_TOP} <= 5) SELECT work_id, string_agg(shelf, '|' ORDER BY count DESC, shelf) AS genres_top FROM t GROUP BY 1")
def tag_listagg(spark, sf):
    return works.joined_tags(tag_rows(spark, sf).where("kind = 'genre'"), "genres_top", 5)


@query(f"""WITH {_TAGS}, t AS (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY work_id, kind ORDER BY count DESC, shelf) <= 3),
g AS (SELECT work_id, string_agg(shelf, '|' ORDER BY count DESC, shelf) AS genres_top FROM t WHERE kind = 'genre' GROUP BY 1), b AS (SELECT work_id, string_agg(shelf, '|' ORDER BY count DESC, shelf) AS badges_top FROM t WHERE kind = 'badge' GROUP BY 1)
SELECT c_custkey AS work_id, genres_top, badges_top, nullif(concat_ws('|', genres_top, badges_top), '') AS shelves_combined FROM customer LEFT JOIN g ON g.work_id = c_custkey LEFT JOIN b ON b.work_id = c_custkey""")
def tags_left_join(spark, sf):
    rows, base = tag_rows(spark, sf), table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("work_id"))
    out = base.join(works.joined_tags(rows.where("kind = 'genre'"), "genres_top", 3), "work_id", "left").join(works.joined_tags(rows.where("kind = 'badge'"), "badges_top", 3), "work_id", "left")
    return out.withColumn("shelves_combined", works.combined_tags(F.col("genres_top"), F.col("badges_top")))


_V1 = f"""{_SHELVES}, named AS (SELECT book_id, regexp_replace(lower(trim(shelf)), '\\s+', ' ', 'g') AS s, greatest(coalesce(count, 0), 0) AS count FROM shelves),
most AS (SELECT book_id, s, max(count) AS weight FROM named GROUP BY 1, 2), tags AS (SELECT book_id, s AS shelf, weight, {_kind_sql(1)} AS kind FROM most), top AS (SELECT * FROM tags WHERE kind <> 'drop' QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY weight DESC, shelf) <= 2)"""


@query(f"WITH {_V1} SELECT * FROM top")
def book_tags_v1(spark, sf):
    return works.book_tags_first_generation(shelves(spark, sf), 2).select("book_id", "shelf", "weight", "kind")


@query(f"""WITH {_V1}, g AS (SELECT book_id, string_agg(shelf, '|' ORDER BY weight DESC, shelf) AS t, string_agg(shelf || ':' || weight, '|' ORDER BY weight DESC, shelf) AS w FROM top WHERE kind = 'genre' GROUP BY 1),
b AS (SELECT book_id, string_agg(shelf, '|' ORDER BY weight DESC, shelf) AS t FROM top WHERE kind = 'badge' GROUP BY 1)
SELECT o_orderkey AS book_id, coalesce(g.t, '') AS genres_top, coalesce(b.t, '') AS badges_top, coalesce(g.w, '') AS genres_top_weights FROM orders LEFT JOIN g ON g.book_id = o_orderkey LEFT JOIN b ON b.book_id = o_orderkey""")
def merge_tags_v1(spark, sf):
    books = table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("book_id"))
    return works.merge_tags_first_generation(books, works.book_tags_first_generation(shelves(spark, sf), 2), 2, weights=True)


@query("""WITH b AS (SELECT *, nullif(o_orderpriority, '1-URGENT') AS title, nullif(o_totalprice, 0) AS price, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) * 1000000000000000 + (o_orderkey % 50) * 1000000 + CAST(o_totalprice / 1000 * 1000 AS BIGINT) AS score FROM orders)
SELECT o_custkey AS work_id, arg_max(o_orderkey, (score, -o_orderkey)) AS rep_book_id, arg_max(title, (score, -o_orderkey)) FILTER (title IS NOT NULL) AS title, arg_max(price, (score, -o_orderkey)) AS price,
  max(o_orderkey % 50) AS ratings_count, CAST(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS has_desc80 FROM b GROUP BY 1""")
def rep_argmax(spark, sf):
    flag = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    b = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("work_id"), F.col("o_orderkey").alias("book_id"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("title"), F.nullif("o_totalprice", F.lit(0.0)).alias("price"),
        (F.col("o_orderkey") % 50).alias("ratings_count"), flag.alias("has_desc80"), works.packed_score(flag, F.col("o_orderkey") % 50, F.col("o_totalprice") / 1000).alias("score"),
    )
    return works.representatives(b, ["title", "price"], maxima=["ratings_count", "has_desc80"])


@query("SELECT l_orderkey, max(CASE WHEN l_quantity > 10 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS weight FROM lineitem GROUP BY 1")
def run_max(spark, sf):
    rows = table(spark, sf, "lineitem", "l_orderkey", "l_quantity")
    return rows.groupBy("l_orderkey").agg(F.max(F.greatest(F.coalesce(F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("bigint")), F.lit(0)), F.lit(0)).cast("bigint")).alias("weight"))


# --- text --------------------------------------------------------------------------------------------------------

_HTML = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))"


@query(f"SELECT page_id, {_HTML} AS description FROM pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", clean.description(F.col("html"), full=False).alias("description"))


@query()
def html_unescape_full(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", clean.description(F.col("html"), apart=True).alias("description"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?i)(https?://[^\\s]+|www\\.[^\\s]+)', ' URL ', 'g'),
  '[\\p{L}\\p{N}_.\\-]+@[\\p{L}\\p{N}_.\\-]+\\.[\\p{L}\\p{N}_]+', ' EMAIL ', 'g')), '[^a-z0-9\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}''\\-]+', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) AS description_clean FROM (SELECT doc_id, replace(text, '&amp;', '&') AS text FROM documents)""")
def clean_text_v1(spark, sf):
    return tables.spread(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", clean.clean_first_generation(F.col("text"), full=False).alias("description_clean"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS description_len, substr(text, 1, 4000) AS description_model FROM documents WHERE length(trim(text)) >= 80")
def length_filter_cap(spark, sf):
    rows = table(spark, sf, "documents", "doc_id", "text").where(clean.has_length(F.col("text")) == 1)
    return rows.select("doc_id", F.length("text").cast("bigint").alias("description_len"), clean.cap(F.col("text")).alias("description_model"))


@query("""WITH q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]) AS q, unnest(v) AS x FROM (SELECT quantile_cont(length(text), [0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]) AS v FROM documents))
SELECT CAST(q AS DOUBLE) AS q, CAST(floor(x) AS BIGINT) AS length FROM q""")
def length_quantiles(spark, sf):
    return ranking.length_quantiles(table(spark, sf, "documents", "text"), "text")


@query("SELECT count(*) FILTER (length(text) > 4000) AS n_truncated, count(*) AS n_rows FROM documents")
def truncated_count(spark, sf):
    return table(spark, sf, "documents", "text").agg(F.count_if(F.length("text") > 4000).alias("n_truncated"), F.count("*").alias("n_rows"))


_WORDS = "regexp_extract_all(text, '([\\p{L}\\p{N}_]{2,})', 1)"
_TERMS = f"""words AS (SELECT doc_id AS id, list_filter({_WORDS}, lambda w: w NOT IN ({_quoted(text.STOP_WORDS)})) AS w FROM documents),
terms AS (SELECT id, unnest(w) AS term FROM words UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1),
tf AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY 1, 2)"""


def docs_of(spark, sf):
    return tables.spread(table(spark, sf, "documents", "doc_id", "text")).where("text is not null").withColumnRenamed("doc_id", "id")


def counts_of(spark, sf, n: int = 2):
    return similarity.term_counts(docs_of(spark, sf), text.terms(F.col("text"), n))


def totals_of(spark, sf, n: int = 2):
    return similarity.term_totals(docs_of(spark, sf), text.terms(F.col("text"), n))


@query(f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS n_tokens, array_to_string({_WORDS}, ' ') AS joined FROM documents")
def tokens(spark, sf):
    w = text.tokens(F.col("text"))
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.array_join(w, " ").alias("joined"))


@query(f"WITH {_TERMS} SELECT id, term, tf FROM tf")
def term_counts(spark, sf):
    return counts_of(spark, sf)


@query(f"WITH {_TERMS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1")
def doc_freq(spark, sf):
    return totals_of(spark, sf)


_VOCAB = "vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1 HAVING count(*) >= 10 AND count(*) <= 0.6 * (SELECT count(*) FROM documents WHERE text IS NOT NULL) ORDER BY cf DESC, term LIMIT {0})"


def vocab_of(spark, sf, n: int = 2, most: int = 80_000):
    docs = docs_of(spark, sf)
    total = docs.count()
    return total, similarity.frequent_terms(docs, text.terms(F.col("text"), n), total, most=most)


@query(f"WITH {_TERMS}, {_VOCAB.format(80000)} SELECT * FROM vocab")
def vocab_prune(spark, sf):
    return vocab_of(spark, sf)[1]


_WEIGHTS = """raw AS (SELECT id, term, tf * (ln((1.0e0 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1.0e0 + df)) + 1.0e0) AS r FROM tf JOIN vocab USING (term)),
norm AS (SELECT id, sqrt(sum(r * r)) AS n FROM raw GROUP BY 1), w AS (SELECT id, term, r / n AS w FROM raw JOIN norm USING (id))"""


def rows_of(spark, sf, n: int = 2, most: int = 80_000, raw: bool = False):
    """TF-IDF rows and the names of their terms; texts are cut into terms again once the vocabulary is known, which
    is cheaper than to keep all terms."""
    total, vocab = vocab_of(spark, sf, n, most)
    return similarity.tfidf_rows(docs_of(spark, sf), text.terms(F.col("text"), n), vocab, total, raw=raw)


def weights_of(spark, sf, n: int = 2, most: int = 80_000):
    return similarity.entries(*rows_of(spark, sf, n, most))


@query(f"WITH {_TERMS}, {_VOCAB.format(80000)}, {_WEIGHTS} SELECT id, term, round(w, 6) AS w FROM w")
def tfidf_weights(spark, sf):
    return weights_of(spark, sf).withColumn("w", F.round("w", 6))


_KNN = f"""WITH {_TERMS}, {_VOCAB.format(80000)}, {_WEIGHTS},
half AS (SELECT a.id, b.id AS neighbor_id, round(sum(a.w * b.w), 6) AS sim FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT * FROM half UNION ALL SELECT neighbor_id, id, sim FROM half)
SELECT id, neighbor_id, sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbor_id) AS BIGINT) AS rank FROM pairs WHERE sim > 0 QUALIFY rank <= 100"""


@query(_KNN)
def tfidf_knn(spark, sf):
    """On 1- and 2-grams with 100 neighbours, as the catalog's plan."""
    rows, idf = rows_of(spark, sf, raw=True)
    out = similarity.knn_rows(rows, len(idf), docs_of(spark, sf).count(), 100, idf=idf, dealt=True)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(_KNN)
def tfidf_knn_postings(spark, sf):
    rows, idf = rows_of(spark, sf, raw=True)
    out = similarity.knn_rows(rows, len(idf), docs_of(spark, sf).count(), 100, dense=similarity.NEVER, idf=idf, dealt=True)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


# --- vectors and pair scores -------------------------------------------------------------------------------------


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) + 0 AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / n) AS u FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, {V} AS v FROM embeddings)))")
def vec_l2(spark, sf):
    u = vectors.unit(F.col("embedding"))
    return table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", u.alias("u")).select("vec_id", F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


_DOT = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))"
_UNITS = f"u AS (SELECT vec_id AS id, list_transform(v, lambda x: x / n) AS v FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, {V} AS v FROM embeddings)))"


def pairs_of(spark, sf):
    """Each vector with the seven that follow it; the last ones point past the end."""
    ids = table(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("work_id"))
    p = ids.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("neighbor_work_id", F.col("work_id") + F.col("j"))
    return p.select("work_id", "neighbor_work_id", (F.lit(1.0) / (1 + (F.col("work_id") * 7 + F.col("j")) % 5)).cast("float").alias("sim_tfidf"), F.col("j").cast("int").alias("rank_tfidf"))


def vecs_of(spark, sf, reverse: bool = False):
    e = F.col("embedding").cast("array<float>")
    return table(spark, sf, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), (F.reverse(e) if reverse else e).alias("vec"))


_PAIRS = "pairs AS (SELECT vec_id AS work_id, vec_id + j AS neighbor_work_id, CAST(1.0e0 / (1 + (vec_id * 7 + j) % 5) AS FLOAT) AS sim_tfidf, CAST(j AS INTEGER) AS rank_tfidf FROM embeddings, range(1, 8) r(j))"
_ZERO = f"zero AS (SELECT p.*, CAST(coalesce({_DOT}, 0) AS FLOAT) AS sim_lda FROM pairs p LEFT JOIN u a ON a.id = work_id LEFT JOIN u b ON b.id = neighbor_work_id)"


@query(f"WITH {_PAIRS}, {_UNITS}, {_ZERO} SELECT work_id, neighbor_work_id, round(CAST(sim_lda AS DOUBLE), 5) + 0 AS sim_lda FROM zero")
def score_missing_zero(spark, sf):
    out = ranking.add_similarity(pairs_of(spark, sf), vecs_of(spark, sf), "sim_lda", missing="zero")
    return out.select("work_id", "neighbor_work_id", F.round(F.col("sim_lda").cast("double"), 5).alias("sim_lda"))


def scored_of(spark, sf):
    """Pairs of known vectors with two scores; rounded, so that ties are the same in any engine."""
    known = pairs_of(spark, sf).join(vecs_of(spark, sf).select(F.col("id").alias("neighbor_work_id")), "neighbor_work_id", "left_semi")
    out = ranking.add_similarity(known, vecs_of(spark, sf), "sim_lda")
    out = ranking.add_similarity(out.select("work_id", "neighbor_work_id", "sim_tfidf", "rank_tfidf", "sim_lda"), vecs_of(spark, sf), "sim_nmf")
    return out.withColumn("sim_lda", F.round("sim_lda", 3)).withColumn("sim_nmf", F.round(F.abs("sim_nmf"), 2))


_SCORED = f"""{_PAIRS}, {_UNITS}, scored AS (SELECT p.*, CAST(round(CAST({_DOT} AS FLOAT), 3) AS FLOAT) AS sim_lda, CAST(round(abs(CAST({_DOT} AS FLOAT)), 2) AS FLOAT) AS sim_nmf FROM pairs p JOIN u a ON a.id = work_id JOIN u b ON b.id = neighbor_work_id)"""
_SCORE = "(CAST(sim_tfidf AS DOUBLE) + CAST(sim_lda AS DOUBLE) + CAST(sim_nmf AS DOUBLE)) / 3.0e0"


@query(f"WITH {_SCORED} SELECT work_id, neighbor_work_id, round(CAST(sim_lda AS DOUBLE), 6) + 0 AS sim_lda, round(CAST(sim_nmf AS DOUBLE), 6) + 0 AS sim_nmf FROM scored")
def scored_pairs(spark, sf):
    return scored_of(spark, sf).select("work_id", "neighbor_work_id", F.round(F.col("sim_lda").cast("double"), 6).alias("sim_lda"), F.round(F.col("sim_nmf").cast("double"), 6).alias("sim_nmf"))


def _variant_sql(order: str, where: str = "") -> str:
    return f"WITH {_SCORED} SELECT work_id, neighbor_work_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY {order}, neighbor_work_id) AS BIGINT) AS rank_variant FROM (SELECT *, {_SCORE} AS score_eq FROM scored) QUALIFY rank_variant <= 4"


def _variant(spark, sf, name):
    return ranking.candidates(scored_of(spark, sf), name, 4).select("work_id", "neighbor_work_id", F.col("rank_variant").cast("bigint").alias("rank_variant"))


@query(_variant_sql("sim_tfidf DESC NULLS LAST, rank_tfidf"))
def top50_tfidf(spark, sf):
    return _variant(spark, sf, "tfidf")


@query(_variant_sql("sim_lda DESC NULLS LAST, sim_tfidf DESC NULLS LAST"))
def top50_lda(spark, sf):
    return _variant(spark, sf, "lda")


@query(_variant_sql("sim_nmf DESC NULLS LAST, sim_tfidf DESC NULLS LAST"))
def top50_nmf(spark, sf):
    return _variant(spark, sf, "nmf")


@query(_variant_sql("score_eq DESC NULLS LAST, sim_tfidf DESC NULLS LAST"))
def top50_equal(spark, sf):
    return _variant(spark, sf, "equal")


@query(f"""WITH {_SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY sim_tfidf DESC, rank_tfidf, neighbor_work_id) AS r FROM scored)
SELECT work_id AS src_work_id, neighbor_work_id AS rec_work_id, round(CAST(sim_tfidf AS DOUBLE), 6) AS sim_tfidf, CAST(NULL AS DOUBLE) AS score_eq, CAST(r AS BIGINT) AS rank_variant, s.c_name AS src_title, t.c_name AS rec_title, s.c_acctbal AS src_average_rating, t.c_acctbal AS rec_average_rating
FROM c JOIN customer s ON s.c_custkey = work_id JOIN customer t ON t.c_custkey = neighbor_work_id WHERE r <= 4""")
def recs_view(spark, sf):
    info = table(spark, sf, "customer").select(F.col("c_custkey").alias("work_id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("average_rating"))
    ranking.publish_serving(info, scored_of(spark, sf), ["title", "average_rating"], 4)
    return spark.sql("SELECT src_work_id, rec_work_id, round(CAST(sim_tfidf AS DOUBLE), 6) AS sim_tfidf, score_eq, CAST(rank_variant AS BIGINT) AS rank_variant, src_title, rec_title, src_average_rating, rec_average_rating FROM v_recs_tfidf")


@query(f"""WITH {_UNITS}, s AS (SELECT a.id, b.id AS neighbor_id, round({_DOT}, 6) AS sim FROM u a JOIN u b ON a.id <> b.id)
SELECT id, neighbor_id, sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbor_id) AS BIGINT) AS rank FROM s WHERE sim > 0 QUALIFY rank <= 10""")
def vec_knn(spark, sf):
    return similarity.vector_knn(table(spark, sf, "embeddings"), 10).withColumn("rank", F.col("rank").cast("bigint"))


# --- candidates, evaluation, samples -----------------------------------------------------------------------------

_BOOKS = """books AS (SELECT c_custkey AS book_id, c_name AS title, c_mktsegment AS author_name, c_mktsegment || '|' || (c_custkey % 3) || '|' AS genres_top, nullif('b' || (c_custkey % 2), 'b1') AS badges_top, c_acctbal AS average_rating, c_custkey % 100 AS ratings_count FROM customer),
cand AS (SELECT c_custkey AS book_id, c_custkey + j AS neighbor_book_id, 1.0e0 / (1 + (c_custkey * 3 + j) % 4) AS sim_tfidf FROM customer, range(1, 6) r(j))"""
_CAND = f"""{_BOOKS}, full_ AS (SELECT c.book_id, coalesce(a.title, '') AS book_title, c.neighbor_book_id, coalesce(b.title, '') AS neighbor_title, coalesce(b.author_name, '') AS neighbor_author, sim_tfidf,
  CAST(row_number() OVER (PARTITION BY c.book_id ORDER BY sim_tfidf DESC, neighbor_book_id) AS BIGINT) AS rank_tfidf,
  CASE WHEN b.book_id IS NULL THEN 0.0e0 ELSE len(list_intersect(list_filter(string_split(a.genres_top, '|'), lambda x: x <> ''), list_filter(string_split(b.genres_top, '|'), lambda x: x <> ''))) / CAST(len(list_distinct(list_concat(list_filter(string_split(a.genres_top, '|'), lambda x: x <> ''), list_filter(string_split(b.genres_top, '|'), lambda x: x <> '')))) AS DOUBLE) END AS genre_overlap,
  coalesce(b.average_rating, 0) AS neighbor_average_rating, coalesce(b.ratings_count, 0) AS neighbor_ratings_count, coalesce(b.genres_top, '') AS neighbor_genres_top, coalesce(b.badges_top, '') AS neighbor_badges_top
  FROM cand c LEFT JOIN books a ON a.book_id = c.book_id LEFT JOIN books b ON b.book_id = c.neighbor_book_id)"""


def first_candidates(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    books = c.select(k.alias("book_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author_name"), F.concat("c_mktsegment", F.lit("|"), (k % 3).cast("string"), F.lit("|")).alias("genres_top"), F.when(k % 2 == 0, "b0").alias("badges_top"), F.col("c_acctbal").alias("average_rating"), (k % 100).alias("ratings_count"))
    pairs = c.select(k.alias("book_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j"))
    pairs = pairs.select("book_id", (F.col("book_id") + F.col("j")).alias("neighbor_book_id"), (F.lit(1.0) / (1 + (F.col("book_id") * 3 + F.col("j")) % 4)).alias("sim_tfidf"))
    return ranking.first_generation_candidates(pairs, books)


@query(f"WITH {_CAND} SELECT * REPLACE (round(genre_overlap, 6) AS genre_overlap, round(sim_tfidf, 6) AS sim_tfidf) FROM full_")
def candidates_v1(spark, sf):
    return first_candidates(spark, sf).withColumn("genre_overlap", F.round("genre_overlap", 6)).withColumn("sim_tfidf", F.round("sim_tfidf", 6))


@query(f"WITH {_CAND} SELECT book_id, neighbor_book_id, round(genre_overlap, 6) AS genre_overlap FROM full_")
def jaccard_overlap(spark, sf):
    return first_candidates(spark, sf).select("book_id", "neighbor_book_id", F.round("genre_overlap", 6).alias("genre_overlap"))


@query(f"WITH {_CAND} SELECT book_id, neighbor_book_id, rank_tfidf FROM full_")
def rank_first(spark, sf):
    return first_candidates(spark, sf).select("book_id", "neighbor_book_id", "rank_tfidf")


@query(f"WITH {_CAND} SELECT book_id, neighbor_book_id, sim_tfidf FROM full_ WHERE rank_tfidf <= 2")
def head_per_group(spark, sf):
    order = [F.desc("sim_tfidf"), F.asc("neighbor_book_id")]
    return works.top_per(first_candidates(spark, sf), "book_id", order, 2).select("book_id", "neighbor_book_id", "sim_tfidf")


@query(f"""WITH {_CAND}, top AS (SELECT * FROM full_ WHERE rank_tfidf <= 3), a AS (SELECT book_id, count(DISTINCT nullif(neighbor_author, '')) AS n FROM top GROUP BY 1)
SELECT round(avg(genre_overlap), 6) AS genre_overlap_mean, round(median(genre_overlap), 6) AS genre_overlap_median, round(quantile_cont(genre_overlap, 0.9), 6) AS genre_overlap_p90,
  (SELECT round(avg(n), 6) FROM a) AS unique_authors_mean, (SELECT CAST(median(n) AS DOUBLE) FROM a) AS unique_authors_median, CAST(median(neighbor_ratings_count) AS DOUBLE) AS popularity_median,
  round(quantile_cont(CAST(neighbor_ratings_count AS DOUBLE), 0.9), 6) AS popularity_p90, round(quantile_cont(CAST(neighbor_ratings_count AS DOUBLE), 0.99), 6) AS popularity_p99, count(*) AS n_pairs FROM top""")
def eval_metrics(spark, sf):
    out = ranking.evaluate(first_candidates(spark, sf), 3)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"WITH {_BOOKS} SELECT book_id AS id FROM cand UNION SELECT neighbor_book_id FROM cand")
def candidate_ids(spark, sf):
    return ranking.candidate_ids(first_candidates(spark, sf))


@query()
def sample_lists(spark, sf):
    return ranking.sample_lists(first_candidates(spark, sf), 20, 3).select("book_id", "neighbor_book_id", "place")


@query("SELECT c.book_id, c.neighbor_book_id FROM (SELECT c_custkey AS book_id, c_custkey + j AS neighbor_book_id FROM customer, range(1, 6) r(j)) c WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c.book_id)")
def semi_sample(spark, sf):
    some = table(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("book_id"))
    return first_candidates(spark, sf).join(some, "book_id", "left_semi").select("book_id", "neighbor_book_id")


@query("SELECT * FROM (SELECT doc_id, CAST(NULL AS VARCHAR) AS absent, source FROM documents ORDER BY doc_id LIMIT 5)")
def head_n(spark, sf):
    return ranking.inspect(table(spark, sf, "documents"), "doc_id", {"doc_id": "bigint", "absent": "string", "source": "string"})[0]


@query("SELECT * FROM (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 5 OFFSET 100)")
def slice_offset(spark, sf):
    return ranking.inspect(table(spark, sf, "documents"), "doc_id", {"doc_id": "bigint", "source": "string"}, at=100)[1]


@query("SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, 'doc_id,text,lang,source,n_chars' AS columns FROM documents")
def file_facts(spark, sf):
    return tables.facts(table(spark, sf, "documents"))


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS description_raw, lang FROM documents WHERE lang = 'en'")
def scan_sql(spark, sf):
    df = tables.project_existing(table(spark, sf, "documents"), {"doc_id": "bigint", "description_raw": "string", "lang": "string"})
    df.createOrReplaceTempView("v_documents")
    return spark.sql("SELECT * FROM v_documents WHERE lang = :lang", args={"lang": "en"})


@query("SELECT source, doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(trim(text)) >= 80 QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) <= 5")
def longest_per_source(spark, sf):
    rows = table(spark, sf, "documents", "source", "doc_id", "text").where(F.length(F.trim("text")) >= 80)
    rows = rows.select("source", "doc_id", F.length("text").cast("bigint").alias("n"))
    return works.top_per(rows, "source", [F.desc("n"), F.asc("doc_id")], 5)


@query()
def random_sample(spark, sf):
    return ranking.sample_exact(table(spark, sf, "documents", "doc_id", "source"), 50, "doc_id")


# --- topic models (checked by invariants, see tests) -------------------------------------------------------------


def _lda(spark, sf):
    return topics.lda(docs_of(spark, sf), fit_docs=None)


@query("""WITH w AS (SELECT p_size % 5 AS topic, p_type AS word, sum(p_retailprice) AS w FROM part GROUP BY 1, 2)
SELECT CAST(topic AS BIGINT) AS topic, string_agg(word, '|' ORDER BY round(w, 2) DESC, word) AS top_words FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY topic ORDER BY round(w, 2) DESC, word) <= 15) GROUP BY 1""")
def top_words(spark, sf):
    """The reduction that both models' keywords go through, from given weights."""
    rows = table(spark, sf, "part", "p_size", "p_type", "p_retailprice").groupBy((F.col("p_size") % 5).alias("topic"), F.col("p_type").alias("word"))
    return topics.top_words(rows.agg(F.round(F.sum("p_retailprice"), 2).alias("w")))


@query()
def lda_topics(spark, sf):
    return _lda(spark, sf)[2]


@query()
def lda_keywords(spark, sf):
    return topics.lda_keywords(*_lda(spark, sf)[:2])


def _nmf(spark, sf):
    rows, names = rows_of(spark, sf)
    blocks = topics.Nmf.packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
    return topics.Nmf().fit(blocks, names), blocks


@query()
def nmf_topics(spark, sf):
    model, weights = _nmf(spark, sf)
    return model.transform(weights, docs_of(spark, sf))


@query()
def nmf_keywords(spark, sf):
    return _nmf(spark, sf)[0].keywords(spark)
