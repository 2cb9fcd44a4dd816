"""Cleaning and parsing of text columns (Column in, Column out)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: What Python's str methods call white space, for Java patterns: Unicode white space and the separators 0x1C-0x1F.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """Null, or only white space; the test ends at the first other character, a visible ASCII one needs no pattern."""
    return c.isNull() | ~(F.ascii(c).between(33, 126) | c.rlike(rf"(?U)[^{SPACE[1:-1]}]"))


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def year(date: Column) -> Column:
    """The first run of exactly four digits that stands alone as a word; null without one."""
    return F.nullif(F.regexp_extract(date, r"\b(\d{4})\b", 1), F.lit("")).try_cast("int")


def year_of_either(published: Column, original: Column) -> Column:
    """The year of publication; that of the original where it is missing or 0."""
    return F.coalesce(F.nullif(year(published), F.lit(0)), year(original))


def page_bucket(pages: Column, short: int = 100, medium: int = 300, long: int = 600) -> Column:
    return F.when(pages < short, "short").when(pages < medium, "medium").when(pages < long, "long").when(pages.isNotNull(), "epic")


def rating_map(dist: Column) -> Column:
    """'5:10|4:2|total:12' as a struct of five counts and the total; the last of equal keys holds.

    A count takes part only where its piece is one digit, a colon and digits; the total may be any integer.
    Take the fields out with ``F.inline(F.array(...))``, so that the text is cut once and not for each of them.
    """

    def of(parts: Column) -> Column:
        def last(pattern: str, to: str) -> Column:
            fit = F.filter(parts, lambda p: p.rlike(pattern))
            return F.regexp_replace(F.try_element_at(fit, F.lit(-1)), to, "").try_cast("bigint")

        stars = [last(rf"^{k}:[0-9]+$", r"^\d:").alias(f"rating_{k}") for k in (5, 4, 3, 2, 1)]
        return F.struct(*stars, last("^total:", "^total:").alias("rating_total"))

    return F.get(F.transform(F.array(F.transform(F.split(dist, r"\|"), strip)), of), F.lit(0))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


#: What Python's html.unescape replaces, each match on its own.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def unescape_each(found: pd.Series) -> pd.Series:
    """HTML entities decoded; the full set has no built-in form."""
    return found.map(lambda x: None if x is None else [html.unescape(e) for e in x])


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities decoded; the full set has no built-in form."""
    return text.map(lambda x: None if x is None else html.unescape(x))


def unescape_apart(c: Column) -> Column:
    """As ``unescape``; only the entities themselves go to Python, not the texts around them.

    Not for the input of another Python function: Spark does not take that out of a filter over lambda functions.
    """
    decoded = unescape_each(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)))
    return F.array_join(F.get(F.transform(F.array(decoded), lambda d: F.transform(F.split(c, ENTITY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(d, i), F.lit(""))))), F.lit(0)), "")


@F.pandas_udf(StringType())
def unescape_nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def unescape_common(c: Column) -> Column:
    """The five entities that most text uses, without leaving the JVM. The ampersand comes last, so that text
    which shows an entity isn't decoded twice."""
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(to))
    return c


def decode(c: Column, full: bool = True, apart: bool = False) -> Column:
    """Entities decoded; ``apart`` sends only them to Python (see ``unescape_apart``)."""
    return (unescape_apart(c) if apart else unescape(c)) if full else unescape_common(c)


def description(c: Column, full: bool = True, apart: bool = False) -> Column:
    """Entities, then tags, then white space; never null for a text, perhaps empty."""
    return collapse(strip_tags(decode(c, full, apart)))


def description_or_null(c: Column, full: bool = True) -> Column:
    return F.nullif(description(c, full), F.lit(""))


def clean_first_generation(c: Column, full: bool = True) -> Column:
    """Lower-case words, with links and addresses replaced by the words url and email; null becomes empty."""
    text = unescape_nfkc(c) if full else unescape_common(c)
    text = strip_tags(text)
    text = F.regexp_replace(text, r"(?i)(https?://[^\s]+|www\.[^\s]+)", " URL ")
    text = F.regexp_replace(text, r"(?U)\b[\w.\-]+@[\w.\-]+\.\w+\b", " EMAIL ")
    text = F.regexp_replace(F.lower(text), rf"(?U)[^a-z0-9\s\x1c-\x1f'\-]+", " ")
    return F.coalesce(collapse(text), F.lit(""))


def cap(c: Column, n: int = 4000) -> Column:
    return F.substring(c, 1, n)


def has_length(c: Column, least: int = 80) -> Column:
    """1 if the trimmed text has that many characters, else 0."""
    return F.when(F.length(F.trim(c)) >= least, 1).otherwise(0)
