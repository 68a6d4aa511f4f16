"""Licence families of paragraphs: trained n-gram classifier, calibrated unknown class, template confirmation.

Training is small and runs on the driver: softmax regression on the presence of word unigrams and bigrams, over the
notices below in many altered forms, made-up licence statements (class unknown) and paragraphs of at most ``sample_rows``
documents (class none), a documented bound. A held-out part of the altered forms sets the temperature and the probability
below which a prediction becomes unknown.

The main path is DataFrame functions only: texts are split into paragraphs and n-grams, joined to the weights (a broadcast table,
at most ``max_features`` rows, checked), and only n-grams with a weight reach the one aggregation, by paragraph. A paragraph with no
such n-gram is of class none, as the training makes sure. The predicted family is confirmed when one of its templates
has at least ``least_containment`` of its n-grams in the paragraph; otherwise the paragraph is reported as unknown.

Every line is judged, and, as notices are usually wrapped, so is every run of lines that have words, joined: a line without words
(blank, or a bare comment mark) ends it. A run has a row where it is confirmed by a template of which none of its lines has as much,
or where none of its lines has a row; in the first case lines that share as many n-grams with that template as with their own
are pieces of the same notice and have no row beside it.

Defined cases: a null or empty text has no paragraph of a licence; repeated rows are reported once each; lines are split at line
feeds and numbered from 0, a run has its first line's number; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm._common import table

#: Public notices by family.
NOTICES = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This program is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1 or 3.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released under the Unlicense."),
    "proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
}
CLASSES = (*NOTICES, "unknown", "none")
TEMPLATES = [(f, t) for f, texts in NOTICES.items() for t in texts]
WORD = "[^a-z0-9]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams(text: str) -> set[str]:
    w = words(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray  # features x classes, divided by the temperature
    bias: np.ndarray
    least: float  # a family's probability below this means unknown
    seen: dict[str, int] = field(default_factory=dict)  # how often the training paragraphs have each word

    def predict(self, text: str) -> tuple[str, float]:
        at = {g: i for i, g in enumerate(self.features)}
        z = self.bias + sum((self.weights[at[g]] for g in sorted(grams(text)) if g in at), np.zeros(len(CLASSES)))
        p = np.exp(z - z.max())
        return CLASSES[int(z.argmax())], float(p.max() / p.sum())


def strong_words(model: Model) -> list[str]:
    """Words of which a paragraph has at least one unless its class is certainly none.

    Each n-gram's weights, as far as they favour a class over none, count for its rarest word. The commonest words are taken for weak as long as all weak
    words together cannot make up, for any class, what the bias of none is ahead; the others are strong.
    """
    ahead = model.bias[-1] - model.bias[:-1]
    gain: dict[str, np.ndarray] = {}
    for g, w in zip(model.features, np.maximum(model.weights[:, :-1] - model.weights[:, -1:], 0)):
        rarest = min(g.split(), key=lambda x: (model.seen.get(x, 0), x))
        gain[rarest] = gain.get(rarest, 0) + w
    left, strong = ahead - 1e-6, []
    for word in sorted(gain, key=lambda x: (-model.seen.get(x, 0), x)):
        if (gain[word] < left).all():
            left = left - gain[word]
        else:
            strong.append(word)
    return strong


def _altered(text: str, noise: list[str], rng: random.Random) -> str:
    w = [x for x in text.split() if rng.random() > 0.12] if len(text.split()) > 5 else text.split()
    around = [rng.choice(noise) for _ in range(rng.randrange(0, 8))] if noise and rng.random() < 0.5 else []
    cut = rng.randrange(0, len(around) + 1)
    return " ".join([*around[:cut], *w, *around[cut:]])


def _made_up(noise: list[str], rng: random.Random) -> str:
    name = "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))).title()
    form = rng.choice(("Licensed under the {} License.", "Released under the {} Public License, version {}.", "This work is licensed under the {} Community License.", "SPDX-License-Identifier: LicenseRef-{}", "Use is subject to the {} license terms.", "This software is distributed under the {} licence."))
    return _altered(form.format(name, rng.randrange(1, 9)), noise, rng)


def train(paragraphs: list[str], max_features: int = 4096, copies: int = 40, seed: int = 6, noise_paragraphs: int = 200, noise_words: int = 40) -> Model:
    """paragraphs: of the corpus; those that mention a licence are left out, the others stand for class none.

    Words put around altered notices are the first noise_words of each of noise_paragraphs paragraphs; the model has max_features n-grams at most.
    These bounds hold for training alone.
    """
    rng = random.Random(seed)
    plain = [p for p in paragraphs if not re.search("(?i)licen[sc]e|copyright|rights reserved|public domain", p)]
    noise = sorted({w for p in plain[:noise_paragraphs] for w in p.split()[:noise_words]})
    rows = [(_altered(t, noise, rng), CLASSES.index(f)) for f, t in TEMPLATES for _ in range(copies)] + [(t, CLASSES.index(f)) for f, t in TEMPLATES]
    rows += [(_made_up(noise, rng), CLASSES.index("unknown")) for _ in range(10 * copies)]
    rows += [(p, CLASSES.index("none")) for p in plain] + [("", CLASSES.index("none"))] * 50
    # plain English, so that common words alone name no licence
    common = "the of and to in is a for on with as by at from this that it be are or an free use work file version terms all rights permission public license software source under".split()
    rows += [(" ".join(rng.choice(common) for _ in range(rng.randrange(3, 25))), CLASSES.index("none")) for _ in range(10 * copies)]
    rng.shuffle(rows)
    sets = [grams(t) for t, _ in rows]
    known = {g for _, t in TEMPLATES for g in grams(t)}
    for s, (_, label) in zip(sets, rows):
        if CLASSES[label] == "unknown":
            known |= {g for g in s if "licen" in g}
    df: dict[str, int] = {}
    for s in sets:
        for g in s & known:
            df[g] = df.get(g, 0) + 1
    features = sorted((g for g, n in df.items() if n >= 3), key=lambda g: (-df[g], g))[:max_features]
    at, k = {g: i for i, g in enumerate(features)}, len(CLASSES)
    x = np.zeros((len(rows), len(features)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i, [at[g] for g in s if g in at]] = 1
    y = np.array([label for _, label in rows])
    fit = np.arange(len(rows)) % 5 != 0
    target = np.eye(k)[y]
    w, b = np.zeros((len(features), k)), np.zeros(k)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)]
    xf, tf = x[fit], target[fit]
    for step in range(1, 201):
        z = xf @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - tf) / len(xf)
        for grad, value, m, v in ((xf.T @ g + 2e-4 * w, w, state[0], state[1]), (g.sum(0), b, state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    held, yh = x[~fit] @ w + b, y[~fit]

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((held - held.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.3, 5, 40), key=lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(yh)), yh], 1e-12)).sum())
    p = probabilities(temperature)
    top, best = p.max(1), p.argmax(1)
    family = best < len(NOTICES)
    wrong = np.sort(top[family & (best != yh)])
    least = float(np.clip(wrong[int(0.9 * (len(wrong) - 1))] + 1e-3 if len(wrong) else 0.5, 0.5, 0.95))
    seen: dict[str, int] = {}
    for x in (x for t in plain for x in words(t)):
        seen[x] = seen.get(x, 0) + 1
    model = Model(features, w / temperature, b / temperature, least, seen)
    if model.predict("")[0] != "none":  # a paragraph without features must be of class none
        model.bias[-1] = model.bias.max() + 1e-6
    return model


def _lowered(text: Column) -> Column:
    """As in words(), only A-Z are lower-cased, so that scan and model agree on letters beyond ASCII."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words_of(lowered: Column) -> Column:
    return F.filter(F.split(lowered, WORD), lambda x: x != "")


def _grams_of(v: Column) -> Column:
    return F.array_distinct(F.concat(v, F.zip_with(v, F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))))


def _units(lines: Column, starts: Column) -> Column:
    """Lines and joined runs: paragraph (number of the first line), lines, run (where it starts, with the line before it) and body."""
    unit = lambda paragraph, n, run, body: F.struct(paragraph.alias("paragraph"), n.cast("int").alias("lines"), run.alias("run"), body.alias("body"))

    def of_run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        first = start + F.when((start > 0) | ~_worded(F.get(lines, F.lit(0))), 1).otherwise(0)
        each = F.transform(F.slice(lines, start + 1, stop - start), lambda line, j: unit(start + j, F.lit(1), start, line))
        joined = F.filter(F.array(unit(first, stop - first, start, F.array_join(F.slice(lines, first + 1, F.greatest(stop - first, F.lit(0))), "\n"))), lambda u: u["lines"] > 1)
        return F.concat(each, joined)

    return F.flatten(F.transform(starts, of_run))


def _worded(line: Column) -> Column:
    return line.rlike("[a-z0-9]")


def scan(docs: DataFrame, model: Model, least_containment: float = 0.6, id_col: str = "doc_id", text: str = "text", max_features: int = 4096) -> DataFrame:
    """doc_id, paragraph, lines, family, probability, template, containment, confirmed, label: one row for each paragraph that is not of class none."""
    if len(model.features) > max_features:
        raise ValueError("too many features to broadcast")
    spark, k, n = docs.sparkSession, len(CLASSES), len(TEMPLATES)
    held = [grams(t) for _, t in TEMPLATES]
    schema = "gram string, " + ", ".join(f"w{i} double" for i in range(k)) + ", " + ", ".join(f"t{i} int" for i in range(n))
    weights = spark.createDataFrame([(g, *map(float, model.weights[i]), *(int(g in h) for h in held)) for i, g in enumerate(model.features)], schema)
    # lines without a strong word are of class none, and so are runs of such lines: they need no n-grams
    strong = F.array(*map(F.lit, strong_words(model))).cast("array<string>")
    lines = F.split(_lowered(F.coalesce(text, F.lit(""))), "\n")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), lines.alias("ls"))
    rows = rows.withColumn("flags", F.transform("ls", lambda line: F.arrays_overlap(_words_of(line), strong))).filter(F.exists("flags", lambda x: x))
    wordless = F.filter(F.transform("ls", lambda line, i: F.when((i > 0) & ~_worded(line), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", F.concat(F.array(F.lit(0)), wordless))
    kept = F.filter(_units(F.col("ls"), F.col("starts")), lambda u: F.exists(F.slice("flags", u["paragraph"] + 1, u["lines"]), lambda x: x))
    rows = rows.select("doc_id", "row", F.explode(kept).alias("u")).select("doc_id", "row", "u.*")
    rows = rows.select("doc_id", "row", "paragraph", "lines", "run", _words_of(F.col("body")).alias("v"))
    rows = rows.select("doc_id", "row", "paragraph", "lines", "run", F.explode(_grams_of(F.col("v"))).alias("gram"))
    met = rows.join(F.broadcast(weights), "gram")
    sums = met.groupBy("row", "doc_id", "paragraph", "lines", "run").agg(F.array(*(F.sum(f"w{i}") + float(model.bias[i]) for i in range(k))).alias("z"), F.array(*(F.sum(f"t{i}") / float(len(held[i])) for i in range(n))).alias("c"))
    top = F.array_max("z")
    p = 1 / F.aggregate("z", F.lit(0.0), lambda acc, z: acc + F.exp(z - F.col("top")))
    named = F.array(*map(F.lit, CLASSES))
    sums = sums.withColumn("top", top).withColumns({"best": F.array_position("z", F.col("top")).cast("int"), "probability": p})
    sums = sums.withColumn("family", F.element_at(named, F.col("best"))).filter("family <> 'none'")
    own = F.array(*(F.when(F.col("family") == f, F.lit(i)) for i, (f, _) in enumerate(TEMPLATES)))
    own = F.transform(F.filter(own, lambda i: i.isNotNull()), lambda i: F.struct(F.element_at("c", i + 1).alias("c"), (-i).alias("i")))
    sums = sums.withColumn("fit", F.array_max(own))
    contained = F.round(F.coalesce(F.col("fit.c"), F.lit(0.0)), 6)
    confirmed = (F.col("probability") >= model.least) & (contained >= least_containment)
    label = F.when((F.col("family") != "unknown") & confirmed, F.col("family")).otherwise("unknown")
    sums = sums.withColumns({"contained": contained, "confirmed": confirmed, "label": label, "at": -F.col("fit.i")})
    one, over = F.col("lines") == 1, Window.partitionBy("row", "run")
    # of a confirmed run: its template, and how much of that each row has
    sums = sums.withColumn("whole", F.max(F.when(~one & (F.col("label") != "unknown"), F.col("at"))).over(over))
    sums = sums.withColumn("of_whole", F.element_at("c", F.col("whole") + 1))
    sums = sums.withColumns({"spans": F.coalesce(F.max(F.when(~one, F.col("of_whole"))).over(over) > F.coalesce(F.max(F.when(one, F.col("of_whole"))).over(over), F.lit(0.0)), F.lit(False)), "n_lines": F.count(F.when(one, 1)).over(over)})
    hits = lambda share, at: share * F.element_at(F.array(*(F.lit(float(len(h))) for h in held)), at + 1)
    piece = F.col("spans") & F.coalesce(hits(F.col("of_whole"), F.col("whole")) >= hits(F.element_at("c", F.col("at") + 1), F.col("at")), F.lit(False))
    sums = sums.filter(F.when(one, ~piece).otherwise(F.col("spans") | (F.col("n_lines") == 0)))
    return sums.select("doc_id", "paragraph", "lines", "family", F.round("probability", 6).alias("probability"), F.col("at").alias("template"), F.col("contained").alias("containment"), "confirmed", "label")


def sample(docs: DataFrame, sample_rows: int = 300, most_paragraphs: int = 6000, most_chars: int = 10_000, id_col: str = "doc_id", text: str = "text") -> list[str]:
    """Training paragraphs: up to most_paragraphs, of most_chars characters at most each, of the sample_rows documents whose ids and texts hash lowest. Tasks
    cut the documents, so the driver gets hashes and these paragraphs only. All bounds are on what the classifier is fitted to; the scan reads
    everything."""
    h = F.xxhash64(id_col, text)
    lowest = [r[0] for r in docs.select(h.alias("h")).orderBy("h").limit(sample_rows).collect()]
    if not lowest:
        return []
    kept = docs.filter(h <= max(lowest)).select(F.coalesce(F.col(text), F.lit("")).alias("text")).limit(sample_rows)
    parts = kept.select("text", F.posexplode(F.split("text", "\n")).alias("at", "p")).filter((F.length("p") > 0) & (F.length("p") <= most_chars))
    return [r[0] for r in parts.orderBy("text", "at").limit(most_paragraphs).select("p").collect()]


def op6_license_paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(sample(docs)))
