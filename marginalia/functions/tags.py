"""Tag names: normal form and kind (drop, badge or genre), by rule tables of two generations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import SPACE, strip

# Names and patterns that decide a tag's kind.
DROP_EXACT_2 = [
    "to-read", "want-to-read", "currently-reading", "read", "tbr",
    "owned", "books-i-own", "owned-books", "my-books", "my-library", "wishlist", "wish-list",
    "kindle", "ebook", "e-book", "ebooks", "audiobook", "audiobooks", "audio", "audio_wanted",
    "default", "reviewed", "recommendations", "books",
]
DROP_PATTERNS_2 = [
    r"(^|-)dnf($|-)",
    r"did[- ]not[- ]finish",
    r"(^|-)not[- ]read($|-)",
    r"(^|-)not[- ]interested($|-)",
    r"\bowned\b",
    r"\bwishlist\b",
    r"\btbr\b",
    r"\bkindle\b|\bebook\b|e-book|\baudio\b|\baudiobook\b",
    r"\bbooks[- ]we[- ]own\b|books-we-own",
    r"\bbooks[- ]i[- ]have\b",
    r"\bi[- ]own\b",
    r"\bto[- ]own\b",
    r"\bto[- ]buy\b",
    r"\bto[- ]read\b",
    r"\b\d[- ]stars?\b",
    r"\bstar[- ]rating\b",
    r"\b\d{4}[- ]books[- ]read\b",
    r"\bbooks[- ]read\b",
    r"\bgeo\b|\blocation\b",
    r"\baaa-geo\b",
    r"^(my[- ]?)?library$",
]
BADGE_PATTERNS_2 = [
    r"\buk0-lib\b",
    r"\breddit\b",
    r"shelfari",
    r"goodreads[- ]choice",
    r"\btop[- ]\d+\b",
    r"\bnational[- ]book[- ]award\b",
    r"\bbooker\b",
    r"\bhugo\b",
    r"\bnebula\b",
    r"\barth?ur[- ]c[- ]clarke\b",
    r"\baward\b|\bprize\b",
    r"\baward[- ]winner\b|\baward[- ]nominee\b",
    r"\bshortlist\b|\blonglist\b",
    r"(^|-)favorites($|-)",
    r"\bfavorites?\b",
    r"\bfavourites?\b",
    r"\bthe[- ].*library\b",
    r"\b.*[- ]library\b",
]
DROP_EXACT_1 = [
    "to-read", "uk0-lib", "currently-reading", "read", "tbr",
    "owned", "books-i-own", "owned-books", "my-books", "my-library", "library", "wishlist", "wish-list", "want-to-read",
    "default", "reviewed", "recommendations",
    "kindle", "ebook", "e-book", "ebooks", "audiobook", "audiobooks", "audio", "audio_wanted", "books",
]
DROP_PATTERNS_1 = [
    r"(^| )dnf( |$)",
    r"did not finish",
    r"(^| )not read( |$)",
    r"(^| )not-read( |$)",
    r"(^| )not interested( |$)",
    r"(^| )not-interested( |$)",
    r"\bowned\b",
    r"\bwishlist\b",
    r"\btbr\b",
    r"\bkindle\b|\bebook\b|e-book|\baudio\b|\baudiobook\b",
    r"\bbooks we own\b|books-we-own",
    r"\buk0-lib\b",
    r"\blibrary\b",
    r"\bmy[- ]?library\b",
    r"\b\d{4}[- ]books[- ]read\b",
    r"\bbooks[- ]read\b",
    r"\bcomics[- ]to[- ]read\b",
    r"\bto[- ]read\b",
    r"\b\d[- ]stars?\b",
    r"\bstar[- ]rating\b",
    r"\bdid[- ]not[- ]finish\b",
    r"\bdnf\b",
    r"\babandoned\b",
    r"\bgeo\b|\blocation\b|\busa\b",
    r"\baaa-geo\b",
    r"\bto[- ]buy\b",
    r"\bto[- ]own\b",
    r"\bbooks[- ]i[- ]have\b",
    r"\bi[- ]own\b",
]
BADGE_PATTERNS_1 = [
    r"\breddit\b",
    r"shelfari",
    r"goodreads[- ]choice",
    r"\btop[- ]\d+\b",
    r"\bnational[- ]book[- ]award\b",
    r"\bbooker\b",
    r"\bhugo\b",
    r"\bnebula\b",
    r"\barth?ur[- ]c[- ]clarke\b",
    r"\baward\b|\bprize\b",
    r"(^|-)favorites($|-)",
    r"\bfavorites?\b",
    r"\bfavourites?\b",
    r"\bclassic(s)?\b",
]
ALWAYS_BADGE_1 = ["favorite", "favourite"]


def any_of(patterns: list[str]) -> str:
    """One alternation, so that a name is matched once per rule table."""
    return "|".join(f"(?:{p})" for p in patterns)


def normal_name(c: Column, generation: int = 2) -> Column:
    """Stripped, lower-cased, white space collapsed; the second generation joins words by hyphens."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), rf"(?U){SPACE}+", "-" if generation == 2 else " ")


def kind(name: Column, generation: int = 2) -> Column:
    """Kind of a normal name; the first rule table that matches decides."""
    if generation == 2:
        drop = name.isin(DROP_EXACT_2) | name.rlike(any_of(DROP_PATTERNS_2))
        badge = name.rlike(any_of(BADGE_PATTERNS_2))
    else:
        drop = name.isin(DROP_EXACT_1) | name.rlike(any_of(DROP_PATTERNS_1))
        badge = name.rlike(any_of([*ALWAYS_BADGE_1, *BADGE_PATTERNS_1]))
    return F.when(drop, "drop").when(badge, "badge").otherwise("genre")
