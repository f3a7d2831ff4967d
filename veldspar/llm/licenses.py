"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are parted by blank lines; line breaks within them are blanks, so wrapped notices
stay whole.  A notice may stand anywhere in a long paragraph, so what is classified are
overlapping windows of its words, of the ``SCALES`` that template pieces fit in.

1. Training windows of families are the template pieces and cuttings of them between words of
   the corpus; unknown windows are ``MAX_UNKNOWN`` at most of each scale, drawn by a hash
   from all texts (the bound is a parameter of the fit), that hold no large part of a piece.
2. Features are hashes (``BUCKETS`` of them) of a window's words and word pairs, scaled to
   unit length.  Softmax regression by proximal gradient steps; the L1 step keeps weights
   sparse; buckets without a word or pair of a piece have none.  The model is one row: a
   place for each bucket that has weights, and the weights of each place.
3. Windows around a cue, a word that a confirmed notice cannot lack, are scored.  A window's
   best family is confirmed if ``OVERLAP`` of the words of one of its pieces and ``IN_ORDER``
   of their neighbouring pairs are in the window, and none of the pairs that tell other
   families (``OTHERS``) or deny the licence (``DENIALS``).  A window that has all words of a
   piece and all its pairs is sure whatever its probability, so a verbatim notice is found
   beside any other texts.
4. The least probability that a family needs is calibrated: a quantile of the best
   probabilities of all paragraphs that have cues but no confirmed window.

All of it is DataFrame functions.  Texts are never shuffled, only results of cued windows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.session import written

BUCKETS = 1 << 14
MAX_UNKNOWN = 400
STEPS = 24
RATE = 60.0
L1 = 0.0001
OVERLAP = 0.8
IN_ORDER = 0.5
SCALES = (12, 32, 96)
CONTEXTS = 4
QUANTILE, LEAST, MOST = 0.99, 0.5, 0.9
UNKNOWN = "unknown"
VERBATIM = min(1 / OVERLAP, 1 / IN_ORDER) - 1e-6

# Notices of licence families, as they are published.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Neighbouring words that tell a family's notices from those of others that differ in a word or two; a window that has one of them isn't the family's.
OTHERS = {
    "CC-BY": ["by sa", "by nd", "by nc", "attribution sharealike", "attribution noderivatives", "attribution noncommercial"],
    "CC-BY-NC": ["by sa", "by nd", "nc sa", "nc nd", "attribution sharealike", "attribution noderivatives", "noncommercial sharealike", "noncommercial noderivatives"],
    "CC-BY-ND": ["by sa", "by nc", "attribution sharealike", "attribution noncommercial"],
    "CC-BY-SA": ["by nd", "by nc", "attribution noderivatives", "attribution noncommercial"],
    "AGPL-3.0": ["gnu general", "lesser general"],
    "GPL-2.0": ["lesser general", "library general", "affero general", "version 3"],
    "GPL-3.0": ["lesser general", "library general", "affero general", "version 2"],
    "LGPL-2.1": ["gnu general", "affero general", "version 3"],
}
# Neighbouring words by which a notice denies its licence.
DENIALS = ["not released", "not licensed", "never released", "never licensed"]
FAMILIES = [*sorted({f for f, _ in TEMPLATES}), UNKNOWN]


def _pieces() -> list[tuple[str, list[str]]]:
    """(family, words) of the templates, cut to what fits in half of the largest scale."""
    out = []
    for family, text in TEMPLATES:
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        parts = -(-len(words) // (SCALES[-1] // 2))
        out += [(family, words[len(words) * i // parts : len(words) * (i + 1) // parts]) for i in range(parts)]
    return out


def _scale(n: int) -> int:
    """The least scale in whose overlapping windows ``n`` words are whole."""
    return next(s for s in SCALES if n <= s // 2)


def cues() -> list[str]:
    """So many of the longest words of each piece that a window without any of them lacks more
    than ``1 - OVERLAP`` of its words and cannot be confirmed."""
    found = set()
    for _, words in _pieces():
        kinds = sorted(set(words), key=lambda w: (-len(w), w))
        found.update(kinds[: int((1 - OVERLAP) * len(kinds) + 1e-9) + 1])
    return sorted(found)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n"), lambda p: F.length(F.trim(F.translate(p, "\n\r\t", "   "))) > 0)


def _pairs(words: Column) -> Column:
    """Word pairs that follow each other."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _features(words: Column) -> Column:
    """Distinct buckets of a window's words and pairs; the last is the bias."""
    hashed = F.transform(F.concat(words, _pairs(words)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))
    return F.array_distinct(F.concat(hashed, F.array(F.lit(BUCKETS))))


def _holds(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(c) for c in cues()])


def _list(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def _overlap(words: Column, pairs: Column, family: Column | None = None) -> Column:
    """The largest share, of words and pairs alike, that a window has of a piece (of a family); ``VERBATIM`` is all of it."""
    shares = []
    for f, piece in _pieces():
        kinds, two = sorted(set(piece)), sorted({f"{a} {b}" for a, b in zip(piece, piece[1:])})  # noqa: B905
        a = F.size(F.array_intersect(words, _list(kinds))) / (OVERLAP * len(kinds))
        b = F.size(F.array_intersect(pairs, F.split(F.lit("|".join(two)), r"\|"))) / (IN_ORDER * max(1, len(two)))
        share = F.least(a, b)
        shares.append(share if family is None else F.when(family == f, share).otherwise(0.0))
    return F.greatest(*shares)


def _windows(words: Column, size: int, starts: Column) -> Column:
    return F.transform(starts, lambda i: F.slice(words, i + 1, size))


def _drawn(documents: DataFrame) -> DataFrame:
    """(h, words): of at most about ``MAX_UNKNOWN`` texts a stretch at a hashed place, twice the largest scale."""
    h = F.xxhash64("text", F.lit(31))
    share = min(1.0, 2 * MAX_UNKNOWN / max(1, documents.count()))
    some = documents.where(F.col("text").isNotNull() & (F.pmod(h, F.lit(1 << 40)) < int(share * (1 << 40)))).select("text", h.alias("h")).distinct()
    some = some.orderBy("h", "text").limit(MAX_UNKNOWN).select("h", _words(F.col("text")).alias("w"))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.size("w") - 2 * SCALES[-1] + 1)).cast("int")
    return written(some.select("h", F.slice("w", at + 1, 2 * SCALES[-1]).alias("words")).where(F.size("words") > 0), "license-drawn")


def _training(documents: DataFrame) -> DataFrame:
    """(family, f) to fit on; ``f`` are a window's features."""
    spark = documents.sparkSession
    drawn = _drawn(documents)
    unknown = [drawn.select(F.lit(UNKNOWN).alias("family"), F.slice("words", 1, s).alias("words")) for s in SCALES]
    unknown = reduce(DataFrame.union, unknown)
    unknown = unknown.where(_overlap(F.col("words"), _pairs(F.col("words"))) < 0.5)
    rows = []
    for family, piece in _pieces():
        n = len(piece)
        for cut in (piece, piece[: max(4, round(0.85 * n))], piece[min(n - 4, round(0.15 * n)) :]):
            rows += [(family, cut, _scale(n), i) for i in range(CONTEXTS)]
    framed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, family string, piece array<string>, scale int, turn int")
    around = drawn.groupBy().agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "words"))), 1, 64).alias("around"))  # MAX_UNKNOWN of them
    context = F.when(F.size("around") > 0, F.col("around")[F.pmod(F.col("i") * 7 + F.col("turn"), F.size("around"))]["words"]).otherwise(F.array().cast("array<string>"))
    room = F.greatest(F.lit(0), F.col("scale") - F.size("piece"))
    lead = F.floor(room * F.col("turn") / (CONTEXTS - 1)).cast("int")
    framed = framed.crossJoin(F.broadcast(around)).withColumn("c", context)  # one row
    whole = F.concat(F.slice("c", 1, lead), F.col("piece"), F.slice(F.col("c"), F.lit(SCALES[-1]), room - lead))
    return framed.select("family", whole.alias("words")).union(unknown).select("family", _features(F.col("words")).alias("f"))


def _sums(places: Column, weights: Column) -> Column:
    """Of each class the sum of weights at the places of a window."""
    zero = F.array(*(F.lit(0.0) for _ in FAMILIES))
    return F.aggregate(places, zero, lambda s, j: F.zip_with(s, weights[j], lambda a, b: a + b))


def _with_p(rows: DataFrame, z: Column) -> DataFrame:
    """``rows`` with ``p``, the softmax of ``z``; in steps, so that nothing is computed twice."""
    rows = rows.withColumn("z", z).withColumn("top", F.array_max("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    return rows.withColumn("p", F.transform("e", lambda x: x / F.col("total"))).drop("z", "top", "e", "total")


def train(documents: DataFrame) -> DataFrame:
    """The model, one row: ``place`` (of each bucket, null if it has none) and ``w`` (of each place and class)."""
    rows = written(_training(documents), "license-rows")
    pieces = documents.sparkSession.createDataFrame([(words,) for _, words in _pieces()], "words array<string>")
    kinds = pieces.select(F.explode(_features(F.col("words"))).alias("b")).distinct()
    vocabulary = kinds.groupBy().agg(F.array_sort(F.collect_list("b")).alias("v"))  # of the pieces
    place = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda b: F.nullif(F.array_position("v", b), F.lit(0)) - 1)
    zero = F.transform("v", lambda b: F.array(*(F.lit(0.0) for _ in FAMILIES)))
    model = written(vocabulary.select(F.transform(place, lambda p: p.cast("int")).alias("place"), zero.alias("w")), "license-model")
    share = rows.groupBy("family").agg((1 / F.count("*")).alias("share"))
    rows = rows.join(F.broadcast(share), "family").crossJoin(F.broadcast(model.select("place")))  # families; one row
    own = F.transform(F.array(*map(F.lit, FAMILIES)), lambda c: (c == F.col("family")).cast("double"))
    points = rows.select(own.alias("own"), "share", (1 / F.sqrt(F.size("f"))).alias("x"), F.filter(F.transform("f", lambda b: F.col("place")[b]), lambda p: p.isNotNull()).alias("at"))
    points = written(points.coalesce(1), "license-points")  # a bounded sample
    bias = model.select(F.col("place")[BUCKETS].alias("p")).first().p
    for _ in range(STEPS):
        held = points.coalesce(1).crossJoin(F.broadcast(model))
        held = _with_p(held, F.transform(_sums(F.col("at"), F.col("w")), lambda z: z * F.col("x")))
        off = F.zip_with("p", "own", lambda a, b: (a - b) * F.col("share") * F.col("x") / len(FAMILIES))
        slope = held.select(off.alias("off"), "at").select("off", F.explode("at").alias("slot")).groupBy("slot").agg(*(F.sum(F.col("off")[c]).alias(f"g{c}") for c in range(len(FAMILIES))))
        slopes = slope.groupBy().agg(F.array_sort(F.collect_list(F.struct("slot", F.array(*(f"g{c}" for c in range(len(FAMILIES)))).alias("g")))).alias("s"))  # one for each place

        def step(w: Column, s: Column) -> Column:
            soft = lambda v: F.when(s["slot"] == bias, v).otherwise(F.signum(v) * F.greatest(F.lit(0.0), F.abs(v) - RATE * L1))
            return F.zip_with(w, s["g"], lambda a, g: soft(a - RATE * g))

        model = written(model.crossJoin(F.broadcast(slopes)).select("place", F.zip_with("w", "s", step).alias("w")), "license-model")
    return model


def _scored(documents: DataFrame, model: DataFrame) -> DataFrame:
    """(a, b, at, family, p, sure, verbatim) of every cued window; a and b name the row, ``at`` its paragraph."""
    held = documents.where(_holds(F.lower("text"))).select(*_names(), F.posexplode(_paragraphs(F.col("text"))).alias("at", "paragraph"))
    held = held.where(_holds(F.lower("paragraph"))).select("a", "b", "at", _words(F.col("paragraph")).alias("words"))
    cued = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(_list(cues()), w), i)), lambda i: i.isNotNull())
    held = held.withColumn("cued", cued).where(F.size("cued") > 0)

    def windows(size: int) -> Column:
        step = size // 2
        starts = F.array_distinct(F.flatten(F.transform("cued", lambda i: F.array(F.floor(i / step), F.greatest(F.lit(0), F.floor(i / step) - 1)))))
        return _windows(F.col("words"), size, F.transform(starts, lambda s: (s * step).cast("int")))

    each = held.select("a", "b", "at", F.explode(F.array_distinct(F.concat(*map(windows, SCALES)))).alias("words"))
    each = each.withColumn("f", _features(F.col("words"))).withColumn("pairs", _pairs(F.col("words")))
    each = each.crossJoin(F.broadcast(model))  # one row
    places = F.filter(F.transform("f", lambda b: F.col("place")[b]), lambda p: p.isNotNull())
    each = _with_p(each, F.transform(_sums(places, F.col("w")), lambda z: z / F.sqrt(F.size("f"))))
    best = F.array_position("p", F.array_max("p")).cast("int") - 1
    each = each.select("a", "b", "at", "words", "pairs", F.array(*map(F.lit, FAMILIES))[best].alias("family"), F.array_max("p").alias("p"))
    other = F.coalesce(*(F.when(F.col("family") == f, F.arrays_overlap("pairs", F.split(F.lit("|".join(pairs)), r"\|"))) for f, pairs in OTHERS.items()), F.lit(False))
    denied = F.arrays_overlap("pairs", F.split(F.lit("|".join(DENIALS)), r"\|"))
    each = each.withColumn("share", F.when(other | denied, 0.0).otherwise(_overlap(F.col("words"), F.col("pairs"), F.col("family"))))
    return each.select("a", "b", "at", "family", "p", (F.col("share") >= 1).alias("sure"), (F.col("share") >= VERBATIM).alias("verbatim"))


def _names() -> list[Column]:
    """Two hashes that name a row; equal rows share them."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b")]


def _threshold(paragraphs: DataFrame) -> float:
    """The quantile of the best probabilities of paragraphs without a confirmed window, within ``LEAST`` and ``MOST``."""
    bins = paragraphs.where(F.size("found") == 0).groupBy(F.floor(F.col("unsure") * 1000).alias("bin")).agg(F.count("*").alias("n")).collect()  # 1,001 at most
    left = (1 - QUANTILE) * sum(r.n for r in bins)
    at = 0.0
    for r in sorted(bins, key=lambda r: -r.bin):
        left -= r.n
        if left < 0:
            at = (r.bin + 1) / 1000
            break
    return min(MOST, max(LEAST, at))


def scanned(documents: DataFrame) -> DataFrame:
    """``doc_id, n_paragraphs, n_licence_paragraphs, families, best_family, best_p`` of every document.

    ``families`` are the confirmed ones, sorted.  Equal paragraphs of a text count one by one;
    a null or blank text has none; repeated rows are scanned alike; null ids are kept; extra
    columns are ignored; an empty table gives no rows.
    """
    docs = documents.select("doc_id", "text")
    windows = _scored(docs, train(docs))
    found = F.collect_set(F.when(F.col("sure") & (F.col("family") != UNKNOWN), F.struct("family", F.round("p", 6).alias("p"), "verbatim")))  # of one paragraph, few kinds
    paragraphs = windows.groupBy("a", "b", "at").agg(found.alias("found"), F.max(F.when(F.col("family") != UNKNOWN, F.col("p")).otherwise(F.lit(0.0))).alias("unsure"))
    paragraphs = written(paragraphs, "license-paragraphs")
    least = _threshold(paragraphs)
    sure = paragraphs.select("a", "b", "at", F.explode("found").alias("x")).where((F.col("x.p") >= least) | F.col("x.verbatim"))
    per = sure.groupBy("a", "b").agg(F.countDistinct("at").alias("n"), F.array_sort(F.collect_set("x.family")).alias("families"), F.max(F.struct("x.p", "x.family")).alias("best"))
    rows = docs.select("doc_id", *_names(), F.size(_paragraphs(F.col("text"))).cast("bigint").alias("n_paragraphs"))
    out = rows.join(per, ["a", "b"], "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licence_paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.col("best.family").alias("best_family"), F.col("best.p").alias("best_p"))


def digest(found: DataFrame) -> DataFrame:
    return found.withColumn("families", F.array_join("families", ","))
