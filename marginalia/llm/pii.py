"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus-digit and digit-dot-digit pairs, digit pairs, schemes and
identifier cues. From each anchor a deterministic local parser walks to the boundaries of the e-mail address,
phone number, network address, card number, link, secret or account it may belong to, and validates it. No
pattern is searched for over the whole text.

Base kinds, as the leftmost non-overlapping matches of
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([ -]?[0-9])+, 13 to 19 digits, Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9], 9 to 15 digits
failing matches are dropped and their text is not tried again. Added kinds: url (a scheme and what follows up to
white space, a quote or an angle bracket, with a host), secret (a cue such as token or password, a separator
and a value of at least 6 characters with a digit), account (an iban cue and an IBAN that passes its check).

Defined results: null texts are empty and have no span; places are code points, ends exclusive; repeated rows
yield the same; texts of any length are read whole, in time linear in them (no parser walks a stretch twice for
more than a bounded number of characters); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account")
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
LINK_END = frozenset(" \t\n\r\x0b\x0c\"'<>`")
VALUE = LETTERS | DIGITS | frozenset("_./+=-")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key")
ACCOUNT_CUES = ("iban",)
LONGEST_IBAN = 34


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in "0123456789":
        a.add_word("+" + d, ("phone", 2))
        for e in "0123456789":
            a.add_word(f"{d}.{e}", ("ip", 3))
            for between in ("", " ", "-"):
                a.add_word(d + between + e, ("card", len(between) + 2))
    for kind, words in (("url", SCHEMES), ("secret", CUES), ("account", ACCOUNT_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                a.add_word(form, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    if not (15 <= len(value) <= LONGEST_IBAN and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in (value[4:] + value[:4]).upper())) % 97 == 1


def _back(t: str, i: int, low: int, allowed: frozenset) -> int:
    while i > low and t[i - 1] in allowed:
        i -= 1
    return i


def _ahead(t: str, i: int, allowed: frozenset) -> int:
    n = len(t)
    while i < n and t[i] in allowed:
        i += 1
    return i


def email_at(t: str, at: int, done: int) -> tuple[int, int] | None:
    """Span around the at-sign at ``at``; ``done`` is the end of the match before."""
    start = _back(t, at, done, LOCAL)
    end = _ahead(t, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(t) and t[end] == ".":
        to = _ahead(t, end + 1, LABEL)
        if to == end + 1:
            break
        end, dots = to, dots + 1
    return (start, end) if dots else None


def phone_at(t: str, plus: int) -> tuple[int, int] | None:
    end = _ahead(t, plus + 2, PHONE)
    while end > plus + 2 and t[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def digit_run(t: str, i: int, low: int, joints: str) -> tuple[int, int]:
    """Digits around ``i`` that are at most one joint apart, not before ``low``."""
    start, end, n = i, i + 1, len(t)
    while start > low:
        if t[start - 1] in DIGITS:
            start -= 1
        elif t[start - 1] in joints and start - 2 >= low and t[start - 2] in DIGITS:
            start -= 2
        else:
            break
    while end < n:
        if t[end] in DIGITS:
            end += 1
        elif t[end] in joints and end + 1 < n and t[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def ips_in(t: str, start: int, end: int) -> list[tuple[int, int]]:
    """Addresses in a run of numbers joined by dots: every four numbers from the left."""
    bounds, at = [], start
    for part in t[start:end].split("."):
        bounds.append((at, at + len(part), part))
        at += len(part) + 1
    out = []
    for k in range(0, len(bounds) - 3, 4):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for _, _, p in bounds[k : k + 4]):
            out.append((bounds[k][0], bounds[k + 3][1]))
    return out


class Secrets:
    """Values after cues: spaces, one of = or :, spaces, an optional quote, the value.

    A run of value characters is walked once, however many cues are in it.
    """

    def __init__(self, t: str):
        self.t, self.to, self.last_digit = t, -1, -1

    def after(self, end: int) -> tuple[int, int] | None:
        t = self.t
        i = _ahead(t, end, frozenset("\"' "))
        if i >= len(t) or t[i] not in "=:":
            return None
        i = _ahead(t, i + 1, frozenset("\"' "))
        if i >= self.to:
            self.to = _ahead(t, i, VALUE)
            self.last_digit = next((k for k in range(self.to - 1, i - 1, -1) if t[k] in DIGITS), -1)
        return (i, self.to) if self.to - i >= 6 and self.last_digit >= i else None


def account_after(t: str, end: int) -> tuple[int, int] | None:
    """The longest IBAN after a cue; the walk ends with the longest number there is, 34 characters."""
    i = _ahead(t, end, frozenset(" :=#"))
    to, held = i, 0
    while to < len(t) and held < LONGEST_IBAN and (t[to] in LETTERS or t[to] in DIGITS or (t[to] == " " and to + 1 < len(t) and (t[to + 1] in DIGITS or t[to + 1].isupper()))):
        held += t[to] != " "
        to += 1
    for stop in range(to, i, -1):
        if t[stop - 1] != " " and (stop == len(t) or t[stop] not in LETTERS | DIGITS) and iban_valid(t[i:stop].replace(" ", "")):
            return i, stop
    return None


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = phone_end = card_end = ip_end = url_end = 0
    secrets = Secrets(text)
    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "card":
            if at >= card_end:
                start, card_end = digit_run(text, at, card_end, " -")
                digits = text[start:card_end].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((start, card_end))
        elif kind == "ip":
            if at >= ip_end:
                start, ip_end = digit_run(text, at, ip_end, ".")
                out["ip"] += ips_in(text, start, ip_end)
        elif kind == "email":
            if at >= email_end and (found := email_at(text, at, email_end)):
                email_end = found[1]
                out["email"].append(found)
        elif kind == "phone":
            if at >= phone_end and (found := phone_at(text, at)):
                phone_end = found[1]
                if 9 <= sum(c in DIGITS for c in text[at:phone_end]) <= 15:
                    out["phone"].append(found)
        elif kind == "url":
            if at >= url_end and text[last + 1 : last + 2].isalnum():
                end = last + 1
                while end < len(text) and text[end] not in LINK_END:
                    end += 1
                while end > last + 1 and text[end - 1] in ".,;:!?)":
                    end -= 1
                url_end = end
                out["url"].append((at, end))
        elif kind == "secret":
            if found := secrets.after(last + 1):
                if not out["secret"] or found[0] >= out["secret"][-1][1]:
                    out["secret"].append(found)
        elif found := account_after(text, last + 1):
            if not out["account"] or found[0] >= out["account"][-1][1]:
                out["account"].append(found)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k in kinds for i, j in spans[k])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, a count for each kind, base (spans of the base kinds) and spans (all), as text."""
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in pieces(batches):
            found = [find(x or "", anchors) for x in b.column("text").to_pylist()]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([joined(f, BASE_KINDS) for f in found], pa.string()), pa.array([joined(f, KINDS) for f in found], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"],
            )

    return base.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans",
        "n_url", "n_secret", "n_account", F.expr(" + ".join(f"n_{k}" for k in KINDS)).alias("n_pii"),
    )
