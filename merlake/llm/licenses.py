"""Licence scans of paragraphs, scored on DataFrame functions only.

A sparse logistic regression over word n-grams (one to three words) gives each paragraph a
probability for every licence family and for the class unknown; a temperature fitted on
statements that the weights have not seen calibrates them.  A family is reported only if the
paragraph also holds most of one of the family's template statements.

The weights are trained on the driver from the templates and from a bounded sample of
paragraphs; scoring joins a paragraph's n-grams with the table of weights, whose size is
that of the templates.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import smallest_hashes

UNKNOWN = "unknown"

#: Statements by which works name their licence, by family.
TEMPLATES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Released under the Apache 2.0 license"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "Released under the GPLv3"],
    "gpl-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPLv2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Dedicated to the public domain"],
    "reserved": ["All rights reserved.", "Copyright, all rights reserved by the authors", "No part of this publication may be reproduced without the prior written permission of the publisher"],
}

#: Words that alone say nothing; n-grams of them only are no features.
STOP_WORDS = "a all and any are as at be been by can for has in is it may may not of on or out part that the this to under use was with without you".split()

_WORD_SPLIT = r"[^\p{L}\p{N}.]+|\.(?=[^\p{N}]|$)"
_PY_WORD = re.compile(r"(?:\w|\.(?=\d))+")


def _words(text: str) -> list[str]:
    """As the columns of ``words`` are, for the Latin text of templates."""
    return [w for w in _PY_WORD.findall(text.lower().replace("_", " "))]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if not all(w in STOP_WORDS for w in words[i : i + n])}


@dataclass(frozen=True)
class LicenseModel:
    """Classes (the last is unknown), a row of weights an n-gram, biases, and the temperature."""

    classes: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(other: list[str], copies: int = 12, steps: int = 250, seed: int = 11) -> LicenseModel:
    """Fit the weights from the templates and from ``other`` paragraphs, which hold no licence.

    Each template gives ``copies`` statements with words dropped or put in; as many
    paragraphs with one to three scattered words of it are unknown.  Three in four train the
    weights, the fourth fits the temperature.
    """
    rng = random.Random(seed)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    vocabulary = sorted(set().union(*(_grams(_words(t)) for ts in TEMPLATES.values() for t in ts)))
    at = {g: k for k, g in enumerate(vocabulary)}
    plain = [_words(t) for t in other] or [["text"]]
    rows: list[tuple[list[str], int]] = [(w, len(classes) - 1) for w in plain]
    for family, statements in sorted(TEMPLATES.items()):
        for statement in statements:
            own = _words(statement)
            rows.append((own, classes.index(family)))
            for _ in range(copies):
                kept = [w for w in own if len(own) < 6 or rng.random() > 0.1]
                filler = rng.choice(plain)[: rng.randint(0, 12)]
                rows.append((kept + filler if rng.random() < 0.5 else filler + kept, classes.index(family)))
                stray = rng.choice(plain)[:20]
                for w in rng.sample(own, min(len(own), rng.randint(1, 3))):
                    stray.insert(rng.randint(0, len(stray)), w)
                rows.append((stray, len(classes) - 1 if len(set(stray) & set(own)) < len(set(own)) * 0.5 else classes.index(family)))
    rng.shuffle(rows)
    x = np.zeros((len(rows), len(vocabulary)))
    for k, (words, _) in enumerate(rows):
        for g in _grams(words):
            if g in at:
                x[k, at[g]] = 1.0
    y = np.eye(len(classes))[[c for _, c in rows]]
    learn = np.arange(len(rows)) % 4 != 3
    w, b, mw, vw = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes)), 0.0, 0.0
    mb = vb = 0.0
    for k in range(1, steps + 1):  # Adam on the whole batch
        gap = (_softmax(x[learn] @ w + b) - y[learn]) / learn.sum()
        gw, gb = x[learn].T @ gap + 1e-5 * w, gap.sum(0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.05 * math.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w -= rate * mw / (np.sqrt(vw) + 1e-8)
        b -= rate * mb / (np.sqrt(vb) + 1e-8)
    z = x[~learn] @ w + b
    loss = lambda t: -np.log(np.clip((_softmax(z / t) * y[~learn]).sum(1), 1e-12, 1)).mean()
    temperature = min((0.25 * 1.1**k for k in range(40)), key=loss)
    return LicenseModel(classes, {g: w[k].tolist() for g, k in at.items()}, b.tolist(), float(temperature))


def fit(docs: DataFrame, sample_docs: int = 200, max_chars: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Train with the paragraphs of ``sample_docs`` documents, those with the smallest hash.

    The sample is bounded by that number and by ``max_chars`` a text.  Paragraphs that hold
    the words of a template are left out of it, as they may be licences.
    """
    rows = docs.where(F.length(text_col).between(1, max_chars)).select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    texts = sorted(r.t for r in smallest_hashes(rows, F.col("h"), sample_docs, docs.count()))
    lines = [x for t in texts for x in t.split("\n") if x.strip()]
    sets = [{w for w in _words(t) if w not in STOP_WORDS} for ts in TEMPLATES.values() for t in ts]
    return train([x for x in lines if not any(len(s & set(_words(x))) * 2 >= len(s) for s in sets)])


def words(text: Column) -> Column:
    """Lower-case words; full stops stay only inside numbers like 2.0."""
    return F.array_remove(F.split(F.lower(F.translate(text, "_", " ")), _WORD_SPLIT), "")


def _grams_of(column: str) -> Column:
    own = F.col(column)
    two = F.transform(F.arrays_zip(own.alias("a"), F.slice(own, F.lit(2), F.size(own)).alias("b")), lambda z: F.concat_ws(" ", z.a, z.b))
    three = F.transform(F.arrays_zip(own.alias("a"), F.slice(own, F.lit(2), F.size(own)).alias("b"), F.slice(own, F.lit(3), F.size(own)).alias("c")), lambda z: F.concat_ws(" ", z.a, z.b, z.c))
    return F.array_distinct(F.concat(own, two, three))


def _template_pairs(model: LicenseModel) -> list[tuple[str, list[str]]]:
    """(family, word pairs that have weights) of every template."""
    return [(name, sorted({f"{a} {b}" for a, b in zip(own, own[1:], strict=False)} & set(model.weights))) for name, statements in sorted(TEMPLATES.items()) for own in map(_words, statements)]


def _judge(likely: DataFrame, key: list[str], model: LicenseModel, threshold: float, contained: float) -> DataFrame:
    """(*key, family, probability, held) of the rows of (*key, grams) that name a licence; held counts word pairs."""
    spark = likely.sparkSession
    k = len(model.classes)
    table = spark.createDataFrame([(g, w) for g, w in sorted(model.weights.items())], "gram string, w array<double>")
    each = likely.select("*", F.explode_outer("grams").alias("gram")).join(F.broadcast(table), "gram")
    by = [*key, "grams"]
    sums = each.groupBy(*by).agg(F.array(*[F.round(F.sum(F.col("w")[c]), 9) for c in range(k)]).alias("sums"))
    numbered = F.array(*[F.struct(F.lit(model.bias[c]).alias("b"), F.lit(c).alias("c")) for c in range(k)])
    logits = sums.select(*by, F.zip_with("sums", numbered, lambda z, n: F.struct(((z + n.b) / model.temperature).alias("z"), n.c.alias("c"))).alias("logits"))
    best = logits.select(*by, "logits", F.array_max("logits").alias("top"))
    total = F.aggregate("logits", F.lit(0.0), lambda t, x: t + F.exp(x.z - F.col("top.z")))
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("top.c") + 1)
    judged = best.select(*by, family.alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= threshold))
    templates = spark.createDataFrame(_template_pairs(model), "family string, pairs array<string>")
    held = judged.join(F.broadcast(templates), "family").select("*", F.size(F.array_intersect("grams", "pairs")).alias("held")).where(F.col("held") >= contained * F.size("pairs"))
    return held.groupBy(*key, "family").agg(F.max("probability").alias("probability"), F.max("held").alias("held"))


def scan_paragraphs(docs: DataFrame, model: LicenseModel, threshold: float = 0.5, contained: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, paragraph, family, probability) of the paragraphs that name a licence.

    A paragraph is a line of the text, numbered from 0.  It is reported if its likeliest class
    is a family of at least ``threshold`` and it holds at least ``contained`` of the word
    pairs of one of that family's templates.  A block, lines up to one without words, is
    reported by the first of its neighbouring lines that name a family together, once for
    each family that none of its lines names alone.  What is only a part of another family's
    statement that holds more pairs isn't reported, be it one line or several.
    """
    anchors = sorted({w for g in model.weights for w in g.split() if w not in STOP_WORDS})
    # the words come out of the generator (an outer one, whose input is not also made for a filter), so they are made once
    lines = F.transform(F.split(text_col, "\n"), words)
    worded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.posexplode_outer(lines).alias("paragraph", "words"))
    # a paragraph without any of the templates' words has no features and is unknown
    likely = worded.where(F.arrays_overlap("words", F.split(F.lit(" ".join(anchors)), " ")))
    # of its n-grams only those with weights go on, a few however long it is
    known = F.split(F.lit("\n".join(sorted(model.weights))), "\n")
    likely = likely.select("doc_id", "text_hash", "paragraph", F.array_intersect(_grams_of("words"), known).alias("grams")).distinct()
    key = ["doc_id", "text_hash", "paragraph"]
    found = _judge(likely, key, model, threshold, contained).drop("held")
    by = ["doc_id", "text_hash", "block"]
    runs = _windows(docs, model, contained, id_col, text_col).select(*by, "at", "n", F.array_intersect(_grams_of("words"), known).alias("grams")).distinct()
    named = _judge(runs, [*by, "at", "n"], model, threshold, contained)
    blocks = named.groupBy(*by).agg(F.collect_list(F.struct("family", "at", "n", "held", "probability")).alias("runs"))
    inside = lambda x, y: (x.at >= y.at) & (x.at + x.n <= y.at + y.n)
    meet = lambda x, y: (x.at < y.at + y.n) & (y.at < x.at + x.n)
    better = lambda x, y: (y.held > x.held) | ((y.held == x.held) & (y.n < x.n))
    # a statement's shortest runs that name its family, and the run that holds most of it
    least = F.filter("runs", lambda x: ~F.exists("runs", lambda y: (y.family == x.family) & (y.n < x.n) & inside(y, x)))
    most = F.filter("runs", lambda x: ~F.exists("runs", lambda y: (y.family == x.family) & meet(x, y) & better(x, y)))
    part = lambda x: F.exists("most", lambda y: (y.family != x.family) & (y.held > x.held) & inside(x, y))
    blocks = blocks.select(*by, least.alias("least"), most.alias("most")).select(*by, F.explode(F.transform("least", lambda x: F.struct(x.alias("run"), part(x).alias("part")))).alias("z"))
    blocks = blocks.select(*by, "z.part", "z.run.*")
    parts = blocks.where("part and n = 1").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("at").alias("line"), F.col("family").alias("f"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("paragraph") == F.col("line")) & (F.col("family") == F.col("f"))
    joined = blocks.where("not part").groupBy(*by, "family").agg(F.min("at").alias("paragraph"), F.max("probability").alias("probability"), F.min("n").alias("n")).where("n > 1")
    return found.join(parts, same, "left_anti").unionByName(joined.select("doc_id", "text_hash", "paragraph", "family", "probability"))


def _least_words(pairs: list[str], need: int) -> int:
    """How many distinct words ``need`` of the pairs have at least: each pair takes two of the words' places."""
    places = Counter(w for p in pairs for w in p.split())
    left, words = 2 * need, 0
    for _, n in places.most_common():
        if left <= 0:
            break
        left, words = left - n, words + 1
    return words


def _windows(docs: DataFrame, model: LicenseModel, contained: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, block, at, n, words) of runs of ``n`` neighbouring lines of the blocks.

    A block is named by its first line, a run starts at line ``at``.  From each line the longest run goes on to the line in which a
    template that starts in the first must have ended; each shorter run is a row too.  Runs begin and end in lines that hold a word of a template
    which isn't a stop word.  Only blocks of several lines that hold enough of a template have rows, as no part of another can be reported.
    """
    longest = max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)
    pairs = [own for _, own in _template_pairs(model)]
    need = [math.ceil(contained * len(own)) for own in pairs]
    numbered = F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("i"), words(x).alias("w")))
    worded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.explode_outer(F.array(numbered)).alias("all"))
    # a text that lacks the words of so many pairs of any template has no such block
    vocabulary = F.split(F.lit(" ".join(sorted({w for own in pairs for p in own for w in p.split()}))), " ")
    own_words = F.array_intersect(F.flatten(F.transform("all", lambda x: x.w)), vocabulary)
    least = F.array(*[F.struct(F.split(F.lit(" ".join(sorted({w for p in own for w in p.split()}))), " ").alias("w"), F.lit(_least_words(own, n)).alias("n")) for own, n in zip(pairs, need, strict=True)])
    # (made by a generator again, else the filter would make them anew for each template)
    worded = worded.select("*", F.explode_outer(F.array(own_words)).alias("own")).where(F.exists(least, lambda t: F.size(F.array_intersect(F.col("own"), t.w)) >= t.n)).drop("own")
    empty = lambda i: F.size(F.get("all", i)["w"]) == 0
    firsts = F.filter("all", lambda x: (F.size(x.w) > 0) & F.when(x.i == 0, True).otherwise(empty(x.i - 1)))
    lasts = F.filter("all", lambda x: (F.size(x.w) > 0) & F.when(x.i == F.size("all") - 1, True).otherwise(empty(x.i + 1)))
    ends = F.zip_with(firsts, lasts, lambda x, y: F.struct(x.i.alias("a"), y.i.alias("b")))
    cut = F.transform(F.filter(ends, lambda z: z.a < z.b), lambda z: F.struct(z.a.cast("int").alias("first"), F.transform(F.slice("all", z.a + 1, z.b - z.a + 1), lambda x: x.w).alias("lines")))
    blocks = worded.select("doc_id", "text_hash", F.explode_outer(cut).alias("block")).select("doc_id", "text_hash", F.col("block.first").alias("block"), F.col("block.lines").alias("lines"))
    own = F.flatten("lines")
    both = F.zip_with(own, F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    known = F.split(F.lit("\n".join(sorted(set().union(*pairs)))), "\n")
    blocks = blocks.where("lines is not null").select("*", F.explode_outer(F.array(F.array_intersect(both, known))).alias("pairs")).where(F.size("pairs") >= min(need))
    templates = F.array(*[F.struct(F.split(F.lit("\n".join(p)), "\n").alias("p"), F.lit(n).alias("n")) for p, n in zip(pairs, need, strict=True)])
    blocks = blocks.where(F.exists(templates, lambda t: F.size(F.array_intersect(F.col("pairs"), t.p)) >= t.n))
    anchors = F.split(F.lit(" ".join(sorted({w for own in pairs for p in own for w in p.split() if w not in STOP_WORDS}))), " ")
    anchored = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.arrays_overlap(F.get("lines", i - 1), anchors))
    starts = blocks.select("doc_id", "text_hash", "block", "lines", F.explode(anchored).alias("at"))
    starts = starts.select("doc_id", "text_hash", "block", "at", F.slice("lines", F.col("at"), F.lit(longest + 1)).alias("lines"))
    runs = starts.select("*", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("n"))
    before = F.size(F.flatten(F.slice("lines", F.lit(2), F.greatest(F.col("n") - 2, F.lit(0)))))
    return runs.where(F.arrays_overlap(F.get("lines", F.col("n") - 1), anchors)).where(before < longest).select("doc_id", "text_hash", "block", (F.col("block") + F.col("at") - 1).alias("at"), "n", F.flatten(F.slice("lines", F.lit(1), F.col("n"))).alias("words"))


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licensed, families, probability.

    n_paragraphs counts lines; n_licensed the lines that name a licence, and each family that
    only several lines of a block name together.  families lists the families that they
    name, sorted and joined by commas, or is empty; probability is the highest of theirs, null if there is none.  A null or empty text
    has no paragraphs.  Repeated rows each get the answer, null ids stay null, other columns
    are ignored, and an empty table gives no rows.
    """
    found = scan_paragraphs(docs, model, id_col=id_col, text_col=text_col)
    by_text = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("f"), F.max("probability").alias("p"))
    by_text = by_text.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    blank = F.coalesce(F.length(text_col) == 0, F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.when(blank, 0).otherwise(F.size(F.split(F.col(text_col), "\n"))).cast("long").alias("n_paragraphs"))
    joined = rows.join(by_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("f", F.lit("")).alias("families"), F.round("p", 6).alias("probability"))
