"""License scans: Dice coefficient over word bigrams against licence templates.

Units of a text are its lines, and its paragraphs (between blank lines) of
two or more lines. Units and templates become words (lower case, letters
and digits) and the set of their bigrams. A unit carries the template whose
2 |shared| / (|unit| + |template|) is the greatest, if that is ``THRESHOLD``
or more: licences that differ in a word or a number are told apart by it. Of
equal templates the longer one counts, then the licence first by name.

A notice may be part of a longer unit: in a comment with code below, or in a
text kept as one line. So the words of the whole text, comment marks being
none, are compared in windows, too: as many words as the template has, laid
so that an anchor word meets itself. At each place of the text that holds an
anchor, all templates with that word compete, and the best one counts as
above. A licence that windows alone carry counts as one unit of its document.

Pruning loses nothing. Sizes: the coefficient is at most 2 min / (min +
max) of both sizes, so a unit meets only the templates within a factor of
t / (2 - t), by an equi-join on the size. Words: a unit that reaches the
threshold holds at least t / (2 - t) of the template's bigrams, so it holds
one of any words that occur in more of its bigrams than may be missing;
such anchors (long words, or bigrams where there are none) are looked for
before a text is taken apart. Windows are cut from chunks of ``CHUNK`` words,
with as many more on either side as the longest template has.

Everything is DataFrame functions. Matches alone are shuffled, for their
counts per document and licence.

Defined results: a null or empty text has no units; rows with the same id
count as one document, null ids too; templates of a single word can't
match; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
LONG_WORD = 6
CHUNK = 256
GAP = r"[^\p{L}\p{N}]+"

_GNU = "it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."

# fixed values: licences, and notices, openings or passages that tell them from their siblings
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("AGPL-3.0", "This program is free software: you can redistribute " + _GNU.format("Affero General Public License", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Released under the BSD License."),
    ("BSD-2-Clause", 'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute " + _GNU.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute " + _GNU.format("General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is free software; you can redistribute " + _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This library is free software: you can redistribute " + _GNU.format("Lesser General Public License", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "CC-BY-4.0", "CC-BY-SA-4.0", "GPL-2.0-only",
        "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
        "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense",
    )),
)


def _bigrams(words: Sequence[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def anchors(bigrams: Sequence[str], threshold: float) -> list[str]:
    """Patterns of which every match holds one: long words, then bigrams, that
    cover more of the bigrams than a match may miss."""
    spare = len(bigrams) * (1 - threshold / (2 - threshold)) + 1e-9
    covered: set[str] = set()
    found = []
    words = {w for b in bigrams for w in b.split() if len(w) >= LONG_WORD}
    for word in sorted(words, key=lambda w: (-len(w), w)):
        fresh = {b for b in bigrams if word in b.split()} - covered
        if fresh and len(covered) <= spare:
            covered |= fresh
            found.append(re.escape(word))
    for bigram in sorted(set(bigrams) - covered, key=lambda b: (-len(b), b)):
        if len(covered) <= spare:
            covered.add(bigram)
            found.append(GAP.join(map(re.escape, bigram.split())))
    return found


def _template_sizes(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(size, license, template): every template under each size a match may have."""
    rows = []
    for name, text in templates:
        grams = _bigrams(_words(text))
        least, most = len(grams) * threshold / (2 - threshold), len(grams) * (2 - threshold) / threshold
        rows += [(n, name, grams) for n in range(1, int(most) + 1) if grams and n >= least - 1e-9]
    return docs.sparkSession.createDataFrame(rows, "size int, license string, template array<string>")


def _units(text: Column) -> Column:
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    return F.concat(lines, paragraphs)


def _distinct_bigrams(words: Column) -> Column:
    count = F.size(words)
    pairs = F.arrays_zip(F.slice(words, F.lit(1), count - 1).alias("a"), F.slice(words, F.lit(2), count - 1).alias("b"))
    return F.array_distinct(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"])))


def _scored(size: Column, shared: Column) -> Column:
    return 2 * shared / (size + F.size("template"))


def _best(met: DataFrame, *place: str) -> DataFrame:
    """(id, license, score): the best template of each place."""
    order = F.struct((-F.col("score")).alias("score"), (-F.size("template")).alias("size"), "license", "id")
    best = met.select(*place, order.alias("best")).groupBy(*place).agg(F.min("best").alias("best"))
    return best.select("best.id", "best.license", (-F.col("best.score")).alias("score"))


def window_keys(templates: Sequence[tuple[str, str]], threshold: float) -> list[tuple[str, str, list[str], int, int]]:
    """(key, license, bigrams, at, words): every place in a template of an anchor of any template."""
    words = [(name, _words(text)) for name, text in templates]
    keys = {a.replace(GAP, " ") for _, w in words if len(w) > 1 for a in anchors(_bigrams(w), threshold)}
    rows = []
    for name, mine in words:
        for key in sorted(keys):
            part = key.split()
            rows += [(key, name, _bigrams(mine), at, len(mine)) for at in range(len(mine)) if len(mine) > 1 and mine[at : at + len(part)] == part]
    return rows


def _window_matches(texts: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """(id, license, score) of the windows of (row, id, text) that carry a template."""
    rows, most = window_keys(templates, threshold), max([1, *(len(_words(text)) for _, text in templates)])
    table = texts.sparkSession.createDataFrame(rows, "key string, license string, template array<string>, at int, words int")
    keys = sorted({r[0] for r in rows})
    # word k of the text is word k - CHUNK * chunk + most of a chunk, from 0; the first chunk has blanks before it
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    padded = texts.select("row", "id", F.concat(F.array_repeat(F.lit(""), most), words).alias("words")).filter(F.size("words") > most + 1)
    begins = F.sequence(F.lit(1), F.size("words") - most, F.lit(CHUNK))
    cut = F.transform(begins, lambda b: F.slice("words", b, CHUNK + 2 * most))
    chunks = padded.select("row", "id", F.posexplode(cut).alias("nth", "chunk"))

    def key_at(p: Column) -> Column:
        word = F.get("chunk", p)
        pair = F.concat_ws(" ", word, F.get("chunk", p + 1))
        return F.filter(F.array(word, pair), lambda k: k.isin(keys))

    own = F.sequence(F.lit(most), F.least(F.size("chunk"), F.lit(most + CHUNK)) - 1)
    found = F.transform(own, lambda p: F.struct(p.alias("p"), key_at(p).alias("keys")))
    hits = chunks.select("row", "nth", "id", "chunk", F.explode(F.filter(found, lambda h: F.size(h["keys"]) > 0)).alias("hit"))
    hits = hits.select("row", "nth", "id", "chunk", F.col("hit.p").alias("p"), F.explode("hit.keys").alias("key"))
    met = hits.join(F.broadcast(table), "key")
    window = F.filter(F.slice("chunk", F.col("p") - F.col("at") + 1, F.col("words")), lambda w: w != "")
    met = met.select("row", "nth", "p", "id", "license", "template", _distinct_bigrams(window).alias("bigrams"))
    shared = F.size(F.array_intersect("bigrams", "template"))
    met = met.withColumn("score", _scored(F.size("bigrams"), shared)).filter(F.col("score") >= threshold)
    return _best(met, "row", "nth", "p")


def find_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and licence: id, license, units that carry it, best score."""
    grams = [_bigrams(_words(text)) for _, text in templates]
    signs = sorted({a for g in grams if g for a in anchors(g, threshold)})
    anchor = "|".join(signs) or "$^"
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).filter(F.col("text").rlike(anchor))
    texts = texts.withColumn("row", F.monotonically_increasing_id())
    units = texts.select("row", "id", F.posexplode(_units(F.col("text"))).alias("nth", "unit")).filter(F.col("unit").rlike(anchor))
    words = F.filter(F.split("unit", GAP), lambda w: w != "")
    units = units.select("row", "nth", "id", words.alias("words")).filter(F.size("words") > 1)
    units = units.select("row", "nth", "id", _distinct_bigrams(F.col("words")).alias("bigrams"))
    # the stated templates: a fixed list, at most a few sizes each
    sizes = F.broadcast(_template_sizes(docs, templates, threshold))
    met = units.withColumn("size", F.size("bigrams")).join(sizes, "size")
    shared = F.size(F.array_intersect("bigrams", "template"))
    met = met.withColumn("score", _scored(F.col("size"), shared)).filter(F.col("score") >= threshold)
    met = _best(met, "row", "nth").withColumn("whole", F.lit(True))
    met = met.union(_window_matches(texts, templates, threshold).withColumn("whole", F.lit(False)))
    whole = F.when(F.col("whole"), F.col("score"))
    return met.groupBy(F.col("id").alias(id_col), "license").agg(
        F.greatest(F.count(whole), F.lit(1)).alias("units"), F.coalesce(F.max(whole), F.max("score")).alias("score")
    )
