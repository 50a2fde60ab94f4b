"""Licence notices in texts, in SQL functions only.

A paragraph (a line of the text) is described by its words and word pairs.  A
logistic regression with a class for every licence family and one for unknown text is trained on the notices
below and on a bounded sample of the corpus's own paragraphs; L1 leaves few weights.  A
temperature chosen on rows kept aside calibrates the probabilities.  A prediction is confirmed if
enough of the word triples of one notice of the family are in the paragraph, or enough of the
paragraph's are those of the family's notices.

Only words with a weight in favour of a family can lift a paragraph above unknown, and frequent ones
whose weights together cannot do so need not be looked for; texts without any of the others, the
anchors, are decided by one comparison of word sets.  Nothing is shuffled: the weights and the
triples of the notices are literals whose size follows from the notices alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import let

# Wordings by which licence families are named and granted.
NOTICES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.", "Licensed under the GNU LGPL."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "you can redistribute it under the terms of the GNU Affero General Public License"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC license."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "dedicated to the public domain"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
UNKNOWN = "unknown"
#: Paragraphs of the corpus that stand for unknown text in training, at most.
SAMPLE_PARAGRAPHS = 1_500
#: A family is reported from this probability on; below, the paragraph is unknown.
MIN_PROBABILITY = 0.5
#: Share of word triples that confirms a prediction.
MIN_TRIPLES = 0.5
_PARTS = r"[^\p{L}\p{N}]+"
#: Splits at least where the one above does around plain letters and digits, and faster.
_PLAIN_PARTS = "[^a-z0-9]+"


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def features(text: str) -> set[str]:
    w = split_words(text)
    return {*w, *grams(w, 2)}


@dataclass
class Classifier:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    #: Words of which any paragraph that is not unknown has at least one.
    anchors: list[str]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(unknown: list[str], l1: float = 2e-4, steps: int = 400, rate: float = 4.0) -> Classifier:
    """Multinomial logistic regression with L1, by proximal gradient steps; every class has the same weight."""
    families = [*NOTICES, UNKNOWN]
    known = {g for texts in NOTICES.values() for t in texts for g in grams(split_words(t), 3)}
    rows = [(t, k) for k, texts in enumerate(NOTICES.values()) for t in _variants(texts)]
    rows += [(t, len(NOTICES)) for t in unknown if not known & set(grams(split_words(t), 3))]
    # text that talks of licences without granting one, and plain prose where the corpus gives none
    rows += [(t, len(NOTICES)) for t in ("the license plate of the car", "the general said to the public", "free software talk", "the source of the river", "a copy of the work")]
    vocabulary = sorted({f for texts in NOTICES.values() for t in texts for f in features(t)})
    index = {f: i for i, f in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (t, _) in enumerate(rows):
        x[i, [index[f] for f in features(t) if f in index]] = 1
    y = np.array([k for _, k in rows])
    aside = np.arange(len(rows)) % 5 == 4
    per_class = np.bincount(y[~aside], minlength=len(families)).clip(1)
    weight = (1 / (len(families) * per_class))[y] * ~aside
    target = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    b[-1] = 1
    for _ in range(steps):
        d = ((_softmax(x @ w + b) - target) * weight[:, None]).astype(np.float32)
        w -= rate * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * d.sum(0)
    b[-1] = max(b[-1], b[:-1].max() + 1)  # no words: unknown
    scores = x[aside] @ w + b

    def loss(t: float) -> float:
        return -float(np.log(_softmax(scores / t)[np.arange(len(scores)), y[aside]] + 1e-12).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    kept = {f: [round(float(v), 6) for v in w[i]] for f, i in index.items() if np.abs(w[i]).max() > 1e-3}
    bias = [round(float(v), 6) for v in b]
    return Classifier(families, kept, bias, temperature, _anchors(kept, bias, Counter(w for t in unknown for w in set(split_words(t)))))


def _anchors(weights: dict[str, list[float]], bias: list[float], seen: Counter) -> list[str]:
    """Words without any of which no family can reach the score of unknown.

    A word or pair is looked for by its word that the sample ``seen`` has least often.  The most frequent of these words are left
    out as long as all their words and pairs together lift no family over unknown; which words are frequent changes the work only.
    """
    lifts: dict[str, np.ndarray] = {}
    for f, v in weights.items():
        lift = np.maximum(np.array(v[:-1]) - v[-1], 0)
        if lift.any():
            word = min(f.split(" "), key=lambda w: (seen[w], w))
            lifts[word] = lifts.get(word, 0) + lift
    room = bias[-1] - np.array(bias[:-1]) - 1e-6
    anchors = []
    for word in sorted(lifts, key=lambda w: (-seen[w], w)):
        if (lifts[word] < room).all():
            room = room - lifts[word]
        else:
            anchors.append(word)
    return sorted(anchors)


def _variants(texts: tuple[str, ...]) -> list[str]:
    """The notices, their sentences, and both with a little text around them."""
    out = []
    for t in texts:
        out += [t, f"{t} See the file for details.", f"Copyright 2021 the authors. {t}", f"Note: {t}"]
        out += [part for part in re.split(r"(?<=[.;,])\s", t) if len(split_words(part)) >= 4]
    return out


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_PARAGRAPHS) -> Classifier:
    """A classifier for the corpus: its own paragraphs, chosen by their hash, are the unknown class."""
    n = docs.count()
    step = max(1, 2 * n // sample)
    chosen = docs.where(F.pmod(F.xxhash64(text_col), F.lit(step)) == 0).select(F.explode(F.split(text_col, "\n", -1)).alias("line"))
    lines = [r.line for r in chosen.where(F.length("line") < 4000).limit(sample).collect()]
    return fit(lines)


def _map_of(entries: dict[str, Column]) -> Column:
    return F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)])


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _grams(words: Column, n: int) -> Column:
    joined = F.transform(
        F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])
    )
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(joined)


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, n_paragraphs, n_licensed, n_confirmed, families, lines, best_probability).

    ``families`` are the distinct families found, in order, comma-joined; ``lines`` lists ``family:line`` (from 0)
    with ``!`` behind confirmed ones.  NULL and empty texts have no paragraphs.  Repeated rows are scanned one by one; other
    columns are not read.
    """
    families = F.array(*[F.lit(f) for f in model.families])
    last = len(model.families) - 1
    weights = _map_of({f: _doubles(w) for f, w in model.weights.items()})
    triples = _map_of({
        f: F.array(*[F.array(*[F.lit(g) for g in sorted(set(grams(split_words(t), 3)))]) for t in texts]) for f, texts in NOTICES.items()
    })
    vocabulary = F.array(*[F.lit(f) for f in model.weights])
    anchors = F.array(*[F.lit(a) for a in model.anchors])
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowered = F.split(F.lower(text), _PLAIN_PARTS, -1)
    lines = F.split(text, "\n", -1)
    paragraphs = F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]"))

    def probabilities(words: Column) -> Column:
        found = F.transform(F.array_intersect(F.concat(words, _grams(words, 2)), vocabulary), lambda g: F.try_element_at(weights, g))
        total = F.aggregate(found, _doubles(model.bias), lambda t, w: F.zip_with(t, w, lambda a, b: a + b))
        exps = lambda s: F.transform(s, lambda v: F.exp((v - F.array_max(s)) / model.temperature))
        share = lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda t, u: t + u))
        return let(let(total, exps), share)

    def judged(line: Column, number: Column) -> Column:
        def of_words(words: Column) -> Column:
            def of_shares(p: Column) -> Column:
                at = F.array_position(p, F.array_max(p)).cast("int") - 1
                family = F.get(families, at)
                own = F.array_distinct(_grams(words, 3))
                notices = F.try_element_at(triples, family)
                shared = F.size(F.array_intersect(own, F.flatten(notices))) >= MIN_TRIPLES * F.size(own)
                whole = F.exists(notices, lambda n: F.size(F.array_intersect(own, n)) >= MIN_TRIPLES * F.size(n))
                return F.struct(
                    family.alias("family"), number.alias("line"), F.array_max(p).alias("p"),
                    F.coalesce(shared | whole, F.lit(False)).alias("confirmed"),
                )

            return let(probabilities(words), of_shares)

        return let(F.filter(F.split(F.lower(line), _PARTS, -1), lambda w: w != F.lit("")), of_words)

    candidates = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: F.arrays_overlap(F.split(F.lower(s["x"]), _PLAIN_PARTS, -1), anchors),
    )
    hits = F.filter(
        F.transform(candidates, lambda s: judged(s["x"], s["i"])),
        lambda h: (h["family"] != F.lit(model.families[last])) & (h["p"] >= MIN_PROBABILITY),
    )
    none = F.expr("cast(array() as array<struct<family:string,line:int,p:double,confirmed:boolean>>)")
    found = F.when(F.arrays_overlap(lowered, anchors), hits).otherwise(none)
    summary = let(
        found,
        lambda h: F.struct(
            F.size(h).cast("bigint").alias("n"),
            F.size(F.filter(h, lambda x: x["confirmed"])).cast("bigint").alias("confirmed"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(h, lambda x: x["family"]))), ",").alias("families"),
            F.array_join(
                F.transform(h, lambda x: F.concat(x["family"], F.lit(":"), x["line"].cast("string"), F.when(x["confirmed"], F.lit("!")).otherwise(F.lit("")))), ","
            ).alias("lines"),
            F.coalesce(F.round(F.array_max(F.transform(h, lambda x: x["p"])), 6), F.lit(0.0)).alias("p"),
        ),
    )
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.size(paragraphs).cast("bigint").alias("n_paragraphs"), summary.alias("s"))
    return rows.select(
        "id", "n_paragraphs", F.col("s.n").alias("n_licensed"), F.col("s.confirmed").alias("n_confirmed"),
        F.col("s.families").alias("families"), F.col("s.lines").alias("lines"), F.col("s.p").alias("best_probability"),
    )
