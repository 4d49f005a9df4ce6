"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are cut into chunks of ``CHUNK`` words, one every ``STEP``; texts are cut into windows of ``CHUNK + STEP``
words, one every ``STEP``, so that each chunk that a text holds lies in a window. A chunk without changes then has a
Jaccard similarity of at least 1/2 with that window (1/4 in the shorter windows for templates under ``CHUNK`` words),
and ``BANDS`` bands of one MinHash value each meet with a probability of 1 - (1 - s) ** 32: above 0.9998 in both cases.
A template counts as found when at least 0.8 of its 5-word shingles are in the text, which is checked exactly.

The band keys of windows and chunks are joined as equals; what meets is checked on the texts' own shingles.

Only texts with an anchor word are cut. The anchors are chosen so that shingles without any are fewer than a match may
lack, hence no text without anchors can match. Everything is DataFrame and SQL functions.

Defined cases: a null or empty text finds nothing and keeps its row; repeated rows are scanned each; a null doc_id
stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

SHINGLE, CHUNK, STEP, BANDS, CONTAINED = 5, 8, 4, 32, 0.8
#: words of all templates up to which their band keys are broadcast: eight keys a word, some 50 MB
MOST_BROADCAST = 250_000

#: fixed values: notices as their licenses word them
TEMPLATES = {
    "mit-short": "Released under the MIT License",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def anchors(templates: dict[str, str] = TEMPLATES) -> list[str]:
    """Words such that, of every template, the shingles without any of them are fewer than a match needs."""
    chosen: set[str] = set()

    def open_shingles(own):
        free = [s for s in own if not chosen & set(s)]
        return free if len(free) >= CONTAINED * len(own) else []

    every = []
    for text in templates.values():
        words = words_of(text)
        every.append({tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})
    while left := [s for own in every for s in open_shingles(own)]:
        counts: dict[str, int] = {}
        for s in left:
            for w in set(s):
                if len(w) > 5:  # common short words are poor anchors
                    counts[w] = counts.get(w, 0) + 1
        chosen.add(max(sorted(counts), key=counts.get))
    return sorted(chosen)


def _shingles(words: str) -> str:
    return f"array_distinct(transform(sequence(1, greatest(size({words}) - {SHINGLE - 1}, 1)), i -> xxhash64(array_join(slice({words}, i, {SHINGLE}), ' '))))"


def _keys(shingles: str) -> str:
    """One MinHash value for each band; the band is part of the hash, so keys of different bands don't meet."""
    return f"transform(sequence(1, {BANDS}), b -> array_min(transform({shingles}, h -> xxhash64(h, b))))"


def _template_frame(spark, templates):
    """(license_id, template, keys): each template's shingles, and the band keys of its chunks."""
    rows = []
    for name, text in templates.items():
        words = words_of(text)
        last = max(0, len(words) - CHUNK)
        starts = sorted({*range(0, last + 1, STEP), last})
        rows.append((name, words, [words[i : i + CHUNK] for i in starts]))
    frame = spark.createDataFrame(rows, "license_id string, words array<string>, chunks array<array<string>>")
    keys = f"array_distinct(flatten(transform(transform(chunks, c -> {_shingles('c')}), c -> {_keys('c')})))"
    return frame.select("license_id", F.expr(_shingles("words")).alias("template"), F.expr(keys).alias("keys"))


def _windows(length: int, step: int, least: int) -> str:
    """Shingles of windows from every ``step``-th word that has ``least`` words from it on."""
    cut = f"transform(sequence(0, greatest(size(words) - {least}, 0), {step}), at -> slice(words, at + 1, {length}))"
    return f"transform({cut}, w -> {_shingles('w')})"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs`` and license found: doc_id, license_id, n_shingles, n_found, containment; one with
    nulls and zeros where none is."""
    spark = docs.sparkSession
    work = Workspace(spark, "licenses")
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    may = F.col("text").rlike("|".join(anchors(templates)))
    words = F.filter(F.split("text", _SPLIT), lambda w: w != "").alias("words")
    anchored = docs.where(may).select("doc_id", F.xxhash64("text").alias("text_key"), words)
    table = _template_frame(spark, templates)

    # band keys that a window and a chunk share name the templates to look at; equal texts are named once
    long, short = (F.expr(f"flatten(transform({_windows(*w)}, s -> {_keys('s')}))") for w in ((CHUNK + STEP, STEP, CHUNK), (CHUNK, 2, SHINGLE)))
    keyed = anchored.where("size(words) > 0").select("text_key", F.explode(F.array_distinct(F.concat(long, short))).alias("key"))
    bands = table.select("license_id", F.explode("keys").alias("key"))
    n_words = sum(len(words_of(t)) for t in templates.values())
    met = keyed.join(F.broadcast(bands) if n_words <= MOST_BROADCAST else bands, "key").select("text_key", "license_id").distinct()
    met = work.keep(met, "met")
    held = met.join(table.select("license_id", "template"), "license_id").groupBy("text_key").agg(F.collect_list(F.struct("license_id", "template")).alias("held"))

    kind = "array<struct<license_id:string,n:int,found:int>>"
    checked = f"filter(transform(held, h -> struct(h.license_id, size(h.template) as n, size(array_intersect(h.template, shingles)) as found)), h -> h.found >= {CONTAINED} * h.n)"
    both = anchored.join(held, "text_key", "left").withColumn("shingles", F.when(F.col("held").isNotNull() & (F.size("words") > 0), F.expr(_shingles("words"))))
    found = both.select("doc_id", F.explode_outer(F.when(F.col("held").isNull(), F.array().cast(kind)).otherwise(F.expr(checked).cast(kind))).alias("f"))
    found = found.select("doc_id", "f.license_id", F.coalesce("f.n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("f.found", F.lit(0)).cast("long").alias("n_found"), F.coalesce(F.col("f.found") / F.col("f.n"), F.lit(0.0)).alias("containment"))
    none = F.lit(0).cast("long")
    rest = docs.where(~may).select("doc_id", F.lit(None).cast("string").alias("license_id"), none.alias("n_shingles"), none.alias("n_found"), F.lit(0.0).alias("containment"))
    return found.unionByName(rest)
