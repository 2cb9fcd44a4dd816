"""License scans by MinHash bands over overlapping text windows; column expressions only, nothing is shuffled.

A template of m shingles (five words each) is looked for in windows of about 3/2 m shingles that start every
half m, so that one window holds any occurrence whole. If a share c >= 0.8 of the template's shingles is there,
the Jaccard similarity of window and template is at least about 0.47, and with 24 bands of one row the chance that
no band collides is under 1e-6. A window whose band collides with a template's is verified by exact containment of
the template's shingles; ``least`` (0.8) of them must be in it.

A band can only collide where the window holds the template's own minimal shingle of that band. Windows without
any such shingle are therefore passed over before their minima are computed; that changes no result.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Templates are a parameter;
they are compiled into the expression in blocks of bounded size, as many as it takes.

A template of three or four words is one shingle of its own length: its words must be there in a row, which is
looked for in the text's words as they stand.

Shingles and results are computed once a row, whatever filter, join or grouping follows.

Defined results: null or empty texts hold no license, texts under five words none but such short ones; a template
under three words is an error; repeated rows yield the same; a text of any length is read whole, in time linear in its words; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fence

WORDS, LEAST, BANDS = 5, 0.8, 24
#: Words of a template, at least.
SHORTEST = 3
#: Shingles of the templates compiled into one expression, at most (unless one template has more).
BLOCK_SHINGLES = 4096

#: Notices and grants as their publishers word them (fixed values).
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def words_of(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower)


def _xx_long(x: int, seed: int) -> int:
    h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def _xx_words(words: list[str]) -> int:
    h = xxhash.xxh64_intdigest(" ".join(words).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def band_hash(shingle: int, band: int) -> int:
    """What xxhash64(shingle, band) is in SQL: a long, then an int, each hashed with the hash before as its seed."""
    return _xx_int(band, _xx_long(shingle, 42))


def _xx_int(x: int, seed: int) -> int:
    h = xxhash.xxh64_intdigest(x.to_bytes(4, "little", signed=True), seed & (1 << 64) - 1)
    return h - (1 << 64) if h >> 63 else h


def compile_template(name: str, text: str, bands: int) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """(name, distinct shingles, bands as (shingle, band, minimum))."""
    words = words_of(text)
    if len(words) < WORDS:
        raise ValueError(f"template {name} has under {SHORTEST} words")
    shingles = list(dict.fromkeys(_xx_words(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))
    rows = []
    for j in range(bands):
        least = min(shingles, key=lambda x: band_hash(x, j))
        rows.append((least, j, band_hash(least, j)))
    return name, shingles, rows


def word_text(text: Column) -> Column:
    """Words of a text, in order, with single spaces between."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _test(h: str, spots: str, compiled: list) -> tuple[Column, str]:
    """The templates as a column, and the SQL test that t, one of them, is found; ``spots``: places of shingles
    that are minimal in some band."""
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(len(s)).alias("m"), F.lit(max(1, (3 * len(s) + 1) // 2)).alias("width"), F.lit(max(1, len(s) // 2)).alias("step"),
            F.array(*map(_long, s)).alias("shingles"),
            F.array(*[F.struct(_long(x).alias("x"), F.lit(j).alias("j"), _long(g).alias("g")) for x, j, g in b]).alias("bands"),
        )
        for name, s, b in compiled
    ])
    # Windows that hold a place p start at multiples of step from ceil((p - width + 1) / step) * step to p.
    starts = "sequence(greatest(0, cast(ceil((p - t.width + 1) / cast(t.step as double)) as int)) * t.step, p, t.step)"
    window = f"slice({h}, a + 1, t.width)"
    collide = f"exists(filter(t.bands, b -> b.x = {h}[p]), b -> array_min(transform({window}, y -> xxhash64(y, b.j))) = b.g)"
    verify = f"size(array_intersect(t.shingles, {window})) >= {LEAST} * t.m"
    test = f"exists(filter({spots}, p -> exists(t.bands, b -> b.x = {h}[p])), p -> exists(filter({starts}, a -> {collide}), a -> {verify}))"
    return rows, test


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, bands: int = BANDS) -> DataFrame:
    """doc_id and licenses (names of the templates found, in order) of each row of ``docs``."""
    short = {n: w for n, t in templates.items() if SHORTEST <= len(w := words_of(t)) < WORDS}
    compiled = [compile_template(n, t, bands) for n, t in templates.items() if n not in short]
    blocks: list[list] = []
    for c in compiled:
        if not blocks or sum(len(x[1]) for x in blocks[-1]) + len(c[1]) > BLOCK_SHINGLES:
            blocks.append([])
        blocks[-1].append(c)
    out = docs.select("doc_id", word_text(F.col("text")).alias("words"))
    held = [F.when(F.concat(F.lit(" "), "words", F.lit(" ")).contains(f" {' '.join(w)} "), F.lit(n)) for n, w in short.items()]
    out = out.select("doc_id", F.split("words", " ").alias("w"), F.array_compact(F.array(*held)).cast("array<string>").alias("s"))
    hashed = "transform(sequence(0, size(w) - 5), i -> xxhash64(concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))"
    out = fence(out, h=F.when(F.size("w") >= WORDS, F.expr(hashed)).otherwise(F.array().cast("array<bigint>"))).select("doc_id", "s", "h")
    parts = []
    for k, block in enumerate(blocks):
        minimal = ", ".join(f"{x}L" for x in sorted({x for _, _, b in block for x, _, _ in b}))
        minimal = minimal.replace("-9223372036854775808L", "bigint('-9223372036854775808')")
        out = out.withColumn(f"p{k}", F.expr(f"filter(transform(h, (y, i) -> if(y in ({minimal}), i, -1)), i -> i >= 0)"))
        rows, test = _test("h", f"p{k}", block)
        out = out.withColumn(f"t{k}", F.when(F.size(f"p{k}") > 0, rows))
        parts.append(F.expr(f"coalesce(transform(filter(t{k}, t -> {test}), t -> t.name), cast(array() as array<string>))"))
    return fence(out, licenses=F.array_sort(F.concat("s", *parts))).select("doc_id", "licenses")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"),
        F.exists("licenses", lambda x: x.rlike("^(all-rights|gpl|cc-by-nc|cc-by-sa|mpl)")).alias("restricted"),
    )
