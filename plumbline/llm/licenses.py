"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

A paragraph (a line of the text) is a sparse set of hashed words and word pairs. A softmax regression over licence families and an
``unknown`` class is fitted on the driver from variants of the templates below and at most NEGATIVES paragraphs of the corpus;
pairs and words that are common in those of them that share no word triple with a template are no features. Its temperature and its acceptance threshold are set on
variants and paragraphs kept apart. A prediction is confirmed when the paragraph shares word triples with a template of its family.

The scan uses built-in functions only: paragraphs without any feature are ``unknown`` by the model itself and end in the scan; the
others are scored by a join with the weights (a table as large as the templates make it).
A pair is a feature only if one of its words is, so looking for the words alone loses no paragraph.

NULL and empty texts have no paragraph with words and no licence, an empty table gives no rows. Paragraphs are read whole, however long,
and each place counts by itself. Repeated rows are reported each for itself; rows that share an id (also NULL) with different texts each have
only their own findings. Of families with equal scores the first in order is taken. Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import smallest

UNKNOWN = "unknown"
NEGATIVES, NEGATIVE_CHARS = 3000, 2000
COMMON = 0.01                 # a feature in more than this share of the corpus paragraphs without a template's triple is none
LEAST_OVERLAP = 0.6
#: Notices and characteristic paragraphs of public licences, by family.
TEMPLATES = {
    "Apache": ("Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
               "SPDX-License-Identifier: Apache-2.0"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Licensed under the BSD License.", "Released under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "SPDX-License-Identifier: GPL-3.0-or-later"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "SPDX-License-Identifier: MIT"),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
}
FAMILIES = tuple(TEMPLATES)
#: Letters of other scripts separate words here: licence notices are English.
SEPARATOR = "[^a-z0-9]+"


@dataclass(frozen=True)
class Model:
    grams: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]      # one row a gram, one number a family and one for unknown
    bias: tuple[float, ...]
    threshold: float


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


def grams_of(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def triples_of(words: list[str]) -> set[str]:
    return {" ".join(t) for t in zip(words, words[1:], words[2:])} or {" ".join(words)}


def _variants(template: str, rng: random.Random, n: int = 12) -> list[list[str]]:
    """The template, parts of it, and the template with words lost or strange words put in."""
    words = words_of(template)
    made = [words]
    for _ in range(n):
        some = [w for w in words if rng.random() > 0.12]
        at = rng.randrange(len(some) + 1) if some else 0
        made.append(some[:at] + [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(4))] + some[at:])
    return made


def fit(paragraphs: list[str], strength: float = 0.02) -> Model:
    """From templates and corpus paragraphs; paragraphs that hold most of a template are left out (they are licences). What is common is
    counted in paragraphs without a word triple of a template: a frequent notice does not make its own words common."""
    rng = random.Random(11)
    split = [words_of(p) for p in paragraphs]
    corpus = [grams_of(w) for w in split]
    whole = [grams_of(words_of(t)) for group in TEMPLATES.values() for t in group]
    told = set().union(*(triples_of(words_of(t)) for group in TEMPLATES.values() for t in group))
    plain = [grams for grams, w in zip(corpus, split) if told.isdisjoint(triples_of(w))]
    counts: dict[str, int] = {}
    for grams in plain:
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    corpus = [g for g in corpus if not any(len(g & t) > 0.5 * len(t) for t in whole)]
    vocabulary = sorted(g for g in set().union(*whole) if counts.get(g, 0) <= COMMON * max(len(plain), 100))
    single = {g for g in vocabulary if " " not in g}
    vocabulary = [g for g in vocabulary if single.intersection(g.split(" "))]
    place = {g: k for k, g in enumerate(vocabulary)}
    rows, truth = [], []
    for k, group in enumerate(TEMPLATES.values()):
        for template in group:
            for words in _variants(template, rng):
                rows.append(grams_of(words))
                truth.append(k)
    # unknown: corpus paragraphs, and single words of the templates among strange ones
    strange = [{*rng.sample(vocabulary, 2), f"w{rng.randrange(10 ** 6)}"} for _ in range(400)]
    for grams in [*corpus, *strange, set()]:
        rows.append(grams)
        truth.append(len(FAMILIES))
    x = np.zeros((len(rows), len(vocabulary)))
    for i, grams in enumerate(rows):
        x[i, [place[g] for g in grams if g in place]] = 1
    y = np.eye(len(FAMILIES) + 1)[truth]
    apart = np.arange(len(rows)) % 5 == 0
    w, b = np.zeros((len(vocabulary), y.shape[1])), np.zeros(y.shape[1])
    share = (1 / y[~apart].sum(0))[np.array(truth)[~apart]]
    share /= share.sum()
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(400):
        z = x[~apart] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - y[~apart]) * share[:, None]
        step_w, step_b = 0.9 * step_w + x[~apart].T @ error + strength / len(rows) * w, 0.9 * step_b + error.sum(0)
        w, b = w - 2.0 * step_w, b - 2.0 * step_b
    z, real = x[apart] @ w + b, np.array(truth)[apart]

    def loss(t: float) -> float:
        q = z * t
        q = q - q.max(1, keepdims=True)
        return -float((q[np.arange(len(real)), real] - np.log(np.exp(q).sum(1))).mean())

    heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = np.exp(z * heat - (z * heat).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    others = p[real == len(FAMILIES)][:, :-1].max(1)
    threshold = float(np.clip(others.max() if len(others) else 0.5, 0.5, 0.9))
    return Model(tuple(vocabulary), tuple(map(tuple, (w * heat).tolist())), tuple((b * heat).tolist()), threshold)


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the whole text), line_no, line of every paragraph."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fitted with the NEGATIVES paragraphs of up to NEGATIVE_CHARS code points that have the smallest hashes."""
    usable = paragraphs(docs, doc_id, text).where(F.length("line").between(1, NEGATIVE_CHARS))
    some = smallest(usable, F.xxhash64("line", "doc_id", "line_no"), NEGATIVES, "line")
    return fit([r["line"] for r in some.select("line").collect()])


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per paragraph that the model takes for a licence: doc_id, copy, line_no, family, probability, overlap, confirmed. A document whose
    row comes twice is reported twice."""
    spark = docs.sparkSession
    words = F.filter(F.split(F.lower("line"), SEPARATOR, -1), lambda w: w != "")
    rows = paragraphs(docs, doc_id, text).select("doc_id", "copy", "line_no", words.alias("words"))
    known = F.array(*[F.lit(g) for g in model.grams])
    rows = rows.where(F.arrays_overlap("words", F.array(*[F.lit(g) for g in model.grams if " " not in g])))
    pairs = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    triples = F.filter(F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))), lambda g: F.size(F.split(g, " ")) == 3)
    rows = rows.select("doc_id", "copy", "line_no", F.array_intersect(F.array_union("words", pairs), known).alias("grams"), F.array_distinct(triples).alias("triples"), F.size("words").alias("n"))
    # equal paragraphs are scored once
    distinct = rows.select("grams").distinct().withColumn("key", F.xxhash64("grams"))
    names = [f"z{k}" for k in range(len(FAMILIES) + 1)]
    weights = spark.createDataFrame([(g, *w) for g, w in zip(model.grams, model.weights)], ", ".join(["gram string", *(f"{n} double" for n in names)]))
    scored = distinct.select("key", "grams", F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy("key", "grams").agg(*[F.sum(n).alias(n) for n in names])
    logits = [F.col(n) + F.lit(b) for n, b in zip(names, model.bias)]
    top = F.greatest(*logits[:-1])
    family = F.coalesce(*[F.when(z == top, F.lit(f)) for z, f in zip(logits, FAMILIES)])
    probability = 1 / sum((F.exp(F.least(z - top, F.lit(700.0))) for z in logits), F.lit(0.0))
    scored = scored.select("grams", family.alias("family"), probability.alias("probability")).where((F.col("probability") > model.threshold))
    templates = [(family, sorted(triples_of(w))) for family, group in TEMPLATES.items() for w in map(words_of, group)]
    table = spark.createDataFrame(templates, "family string, template array<string>").groupBy("family").agg(F.collect_list("template").alias("templates"))
    found = rows.join(scored, "grams").join(F.broadcast(table), "family")
    shared = F.transform("templates", lambda t: F.size(F.array_intersect("triples", t)) / F.least(F.size(t), F.greatest(F.size("triples"), F.lit(1))))
    found = found.withColumn("overlap", F.array_max(shared))
    return found.select("doc_id", "copy", "line_no", "family", "probability", "overlap", (F.col("overlap") >= LEAST_OVERLAP).alias("confirmed"))


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, families (confirmed, in order), findings (every paragraph taken for a licence, also unconfirmed)."""
    found = scan(docs, model or train(docs, doc_id, text), doc_id, text).distinct()
    by_doc = found.groupBy(F.col("doc_id").alias("id"), F.col("copy").alias("of")).agg(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
                                                            F.sort_array(F.collect_list(F.struct("line_no", "family", "probability", "overlap", "confirmed"))).alias("findings"))
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"))
    return ids.join(by_doc, ids["doc_id"].eqNullSafe(by_doc["id"]) & (ids["copy"] == by_doc["of"]), "left").select("doc_id", F.coalesce("families", F.expr("cast(array() as array<string>)")).alias("families"), "findings")
