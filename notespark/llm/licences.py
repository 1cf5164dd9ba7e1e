"""Operator 5, licence scans: a trained paragraph classifier over sparse word n-grams, with an unknown class and template checks.

Training (driver, built-in texts only, some seconds): multinomial logistic regression with an L1 penalty on 1- to 3-grams of words
of the notices below, their variants, and licence-like texts that are no licence. Temperature and the bound for `unknown` are
calibrated on notices of which the fit has seen no variant; then all are fitted. Features are n-grams that contain a licence word (ANCHORS), so a paragraph without any of these
words has no feature at all and scores as unknown: skipping it is exact.

Scoring (DataFrame functions only): documents with an anchor are split into paragraphs at blank lines, so that a notice that is
wrapped over several lines is judged whole; each of their lines is judged too, so that a notice in a line of a long paragraph stands
out. Distinct paragraphs and lines are scored once, by joining their n-grams with the model (at most MAX_FEATURES rows, built from this module: a bounded broadcast) and summing; so a
notice in most documents costs one row. The predicted family is confirmed where the paragraph covers enough of one of its templates.

Null text: no paragraph. Rows that repeat are each answered. Very long paragraphs are scored whole. Empty table: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, read, small_side, write_table

MAX_FEATURES = 6000
COVERAGE = 0.6
UNKNOWN = "unknown"
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
ANCHORS = r"licen[sc]|\bcc\b|\bcc0\b|creative|copyright|copyleft|gpl|gnu|spdx|reserved|redistribut|domain|permission|warrant|commons|apache|mozilla|mpl|bsd|eclipse|epl|proprietary|confidential|isc|zlib|artistic"

# Short public notices by family.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL v2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "Released under the LGPL."],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Released under the AGPL v3."],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "EPL": ["Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Content is available under the Creative Commons Attribution license."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike license."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense", "This work is in the public domain."],
    "proprietary": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "(c) 2019 All Rights Reserved"],
}
OTHER = [
    "Please show your driver license at the desk.", "The license plate was stolen.", "Fishing license fees went up this year.", "A poetic license was taken by the author.", "He lost his licence after the accident.",
    "See the license for details.", "The table was reserved for two.", "She is quiet and reserved.", "The domain name expired.", "a public domain expert", "Ask for permission first.", "You need permission to enter this room.",
    "The warranty covers two years.", "This comes without any warranty for the battery.", "Copyright law is complicated.", "The copyright office opened in 1870.", "The House of Commons voted.", "The common and the commons.",
    "Apache helicopters and the Apache people", "Restart apache on the server.", "The gnu is an antelope.", "An eclipse of the sun.", "Artistic freedom matters.", "confidential documents were leaked", "Redistribution of income", "the mozilla browser crashed",
    "Domain experts reserved the license of commons", "under the terms of the agreement", "distributed under the tree", "licensed professional engineer", "the licensed dealer", "reserved seats", "rights of way", "all rights and duties", "public license", "general public",
]


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def ngrams(ts: list[str]) -> set[str]:
    """1- to 3-grams with an anchor."""
    every = {" ".join(ts[i : i + n]) for n in (1, 2, 3) for i in range(len(ts) - n + 1)}
    return {g for g in every if re.search(ANCHORS, g)}


def _variants(text: str, rng: np.random.Generator, n: int) -> list[str]:
    out, words = [text], text.split()
    filler = "the of and in to with on for is this that file project code work page site by from our".split()
    for _ in range(n):
        w = list(words)
        for _ in range(int(rng.integers(0, 3))):
            if len(w) > 4:
                w.pop(int(rng.integers(0, len(w))))
        before = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 6)))]
        after = [filler[i] for i in rng.integers(0, len(filler), int(rng.integers(0, 6)))]
        out.append(" ".join(before + w + after))
    return out


class Model:
    """Sparse weights by n-gram, bias by class, temperature, and the least probability of a family."""

    def __init__(self, classes, features, weights, bias, temperature, least):
        self.classes, self.features, self.weights, self.bias, self.temperature, self.least = classes, features, weights, bias, temperature, least

    def probabilities(self, text: str) -> dict[str, float]:
        """By plain Python, for tests."""
        at = [self.features[g] for g in ngrams(tokens(text)) if g in self.features]
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        p = np.exp(z - z.max())
        return dict(zip(self.classes, p / p.sum()))


def _fit(a: np.ndarray, b: np.ndarray, steps: int, l1: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial regression by proximal gradient steps with momentum."""
    w, c = np.zeros((a.shape[1], b.shape[1]), np.float32), np.zeros(b.shape[1], np.float32)
    vw, vc = np.zeros_like(w), np.zeros_like(c)
    rate = 1.0
    for _ in range(steps):
        z = a @ w + c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - b) / len(a)
        vw, vc = 0.9 * vw + a.T @ d, 0.9 * vc + d.sum(axis=0)
        w, c = w - rate * vw, c - rate * vc
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, c


def _calibrate(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Temperature of least log loss, and the least probability at which 95 % of what is named is right (or the one that comes nearest)."""
    best, temperature = np.inf, 1.0
    for s in np.geomspace(0.25, 4, 25):
        q = z / s
        loss = float(np.mean(np.log(np.exp(q - q.max(axis=1, keepdims=True)).sum(axis=1)) + q.max(axis=1) - q[np.arange(len(t)), t]))
        if loss < best:
            best, temperature = loss, float(s)
    q = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    top, sure = q[:, 1:].argmax(axis=1) + 1, q[:, 1:].max(axis=1)
    nearest, least = -1.0, 0.5
    for bound in np.linspace(0.3, 0.9, 25):
        named = sure >= bound
        right = float((top[named] == t[named]).mean()) if named.any() else 0.0
        if right > nearest:
            nearest, least = right, float(bound)
        if right >= 0.95:
            break
    return temperature, least


@cache
def train(variants: int = 12, steps: int = 300, l1: float = 2e-4, seed: int = 5) -> Model:
    """Calibrates on every third notice with a fit on the others, then fits all of them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    classes = [UNKNOWN, *NOTICES]
    texts, labels, held = [], [], []
    for y, group in enumerate([OTHER, *NOTICES.values()]):
        for i, t in enumerate(group):
            vs = _variants(t, rng, variants)
            texts += vs
            labels += [y] * len(vs)
            held += [i % 3 == 1] * len(vs)
    texts += ["", "the of and in to"] * 40
    labels += [0] * 80
    held += [False] * 80
    grams = [ngrams(tokens(t)) for t in texts]
    counts: dict[str, int] = {}
    for g in grams:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    kept = sorted(x for x, c in counts.items() if c >= 3)
    kept = sorted(sorted(kept, key=lambda x: (-counts[x], x))[:MAX_FEATURES])
    features = {x: i for i, x in enumerate(kept)}
    x = np.zeros((len(texts), len(kept)), np.float32)
    for i, g in enumerate(grams):
        x[i, [features[f] for f in g if f in features]] = 1
    y, held = np.eye(len(classes), dtype=np.float32)[labels], np.array(held)
    w, c = _fit(x[~held], y[~held], steps, l1)
    temperature, least = _calibrate(x[held] @ w + c, np.array(labels)[held])
    w, c = _fit(x, y, steps, l1)
    used = np.abs(w).sum(axis=1) > 0
    return Model(classes, {f: i for i, f in enumerate(np.array(kept)[used].tolist())}, w[used].round(5).astype(float), c.round(5).astype(float), temperature, least)


def _grams(ts: Column) -> Column:
    """Distinct 1- to 3-grams with an anchor."""

    def of(n: int) -> Column:
        last = F.size(ts) - n
        every = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(ts, i + k) for k in range(n)])))
        return F.coalesce(every, F.array().cast("array<string>"))

    return F.filter(F.array_distinct(F.concat(of(1), of(2), of(3))), lambda g: g.rlike(ANCHORS))


def _score(paragraphs: DataFrame, model: Model) -> DataFrame:
    """paragraphs(md, paragraph), distinct: md, family, probability, coverage, confirmed."""
    spark = paragraphs.sparkSession
    k = len(model.classes)
    known = spark.createDataFrame([(f, [float(v) for v in model.weights[i]]) for f, i in model.features.items()], "gram string, w array<double>")
    words = paragraphs.select("md", F.regexp_extract_all(F.lower("paragraph"), F.lit(TOKEN), F.lit(0)).alias("ts"))
    found = words.select("md", F.explode(_grams(F.col("ts"))).alias("gram")).join(F.broadcast(known), "gram")
    sums = found.groupBy("md").agg(F.array(*[F.sum(F.get("w", F.lit(j))) for j in range(k)]).alias("z"))
    bias = F.array(*[F.lit(float(v)) for v in model.bias])
    z = F.transform(F.coalesce("z", F.array_repeat(F.lit(0.0), k)), lambda v, j: (v + F.get(bias, j)) / model.temperature)
    scored = words.join(sums, "md", "left").select("md", "ts", z.alias("z"))
    scored = scored.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    scored = scored.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda s, u: s + u)))
    sure = F.array_max(F.slice("p", 2, k - 1))
    at = F.array_position(F.slice("p", 2, k - 1), sure)
    names = F.array(*[F.lit(c) for c in model.classes])
    family = F.when(sure >= model.least, F.get(names, at.cast("int"))).otherwise(F.lit(UNKNOWN))
    scored = scored.select("md", "ts", family.alias("family"), F.round(sure, 4).alias("sure"))
    templates = spark.createDataFrame([(f, [sorted(set(tokens(t))) for t in ts]) for f, ts in NOTICES.items()], "family string, templates array<array<string>>")
    with_templates = scored.join(F.broadcast(templates), "family", "left")
    cover = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("ts"))) / F.size(t)))
    return with_templates.select("md", "family", F.col("sure").alias("probability"), F.round(F.coalesce(cover, F.lit(0.0)), 4).alias("coverage"), (F.coalesce(cover, F.lit(0.0)) >= COVERAGE).alias("confirmed"))


def paragraphs(text: Column) -> Column:
    """Array of (paragraph, lines, said): the number of the first line, of lines, and the text, for each line, and for each run of two or more
    lines without a blank one between them, joined by blanks."""
    lines = F.split(text, "\n", -1)
    none = F.array().cast("array<struct<paragraph:int,lines:int,said:string>>")

    def row(at: Column, n: Column, said: Column) -> Column:
        return F.struct(at.cast("int").alias("paragraph"), n.cast("int").alias("lines"), said.alias("said"))

    def runs(ls: Column) -> Column:
        """Blank lines part the line numbers; what lies between two of them is a run."""
        gaps = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.trim(F.get(ls, i)) == ""), F.array(F.size(ls)))

        def between(g: Column) -> Column:
            every = F.transform(F.slice(g, 1, F.size(g) - 1), lambda a, i: row(a + 1, F.get(g, i + 1) - a - 1, F.array_join(F.slice(ls, a + 2, F.greatest(F.get(g, i + 1) - a - 1, F.lit(0))), " ")))
            return F.filter(every, lambda r: r["lines"] >= 2)

        return let(gaps, between)

    return F.coalesce(let(lines, lambda ls: F.concat(F.transform(ls, lambda s, i: row(i, F.lit(1), s)), runs(ls))), none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Per line with a licence word, and per paragraph of several lines with one: doc_id, paragraph (the number of its first line), lines (how many),
    family, probability, coverage, confirmed."""
    model = model or train()
    likely = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(f"(?i){ANCHORS}"))
    every = likely.select("doc_id", F.inline(F.filter(paragraphs(F.col("text")), lambda p: p["said"].rlike(f"(?i){ANCHORS}"))))
    lines = write_table(every.withColumn("md", F.md5("said")), "licence-lines", "licence")
    distinct = lines.groupBy("md").agg(F.min("said").alias("paragraph"))
    scored = write_table(_score(distinct, model), "licence-scored", "licence")
    found = lines.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("lines").cast("long").alias("lines"), "md")
    return found.join(small_side(scored, BROADCAST_ROWS // 4), "md").drop("md")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op5_licences": op5_licences}
SQL: dict[str, str] = {}
