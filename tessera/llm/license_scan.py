"""Licence scan by a trained paragraph classifier, in DataFrame operations only.

Three kinds of segments are judged: lines; of lines over 80 words, windows of 80 words at every 40th; and, as notices are often
wrapped, neighbouring lines of one paragraph (no blank line between, no line over 30 words), from each line on up to six of them. The
words and neighbouring word pairs of a segment are looked up in a sparse multinomial logistic regression over
licence families and the class `unknown`. The model is fitted on the driver: positives are made from the notices below
(words dropped and other text put around them), negatives are at most `background` lines of a bounded number of documents (those of
smallest hashed id) and misuses of licence words. A temperature and an offset of `unknown` calibrate the probabilities; they are fitted
on notices that took no part in the model (each half of every family's notices is judged by a model of the other half) and on held-out lines. A
segment whose best family stays under `least` is unknown. A family is confirmed only against the wording of its notices: within the segment, at least `alike`
of the words and 0.4 of the neighbouring pairs of one of them. Of overlapping segments that confirm one family the closest is reported.

Segments without any telling word are unknown without scoring: so many words of each notice are telling that without them less than
`alike` of it is left, so that no segment that could be confirmed is passed over. Everything is computed within the row,
so nothing is shuffled and no family or source can be hot.

Cases: null text counts as empty; empty lines are unknown; a text with no licence has empty arrays; rows with equal ids are
scanned each for itself; null ids are scanned; very long lines are read whole, in windows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table

#: Short public notices by family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the terms of the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the AGPL, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "Licensed under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Dedicated to the public domain under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright 2020 by the author. All rights reserved. No part of this publication may be reproduced without written permission.",
    ],
}
#: Licence words in other senses.
MISUSES = [
    "He lost his driving license last year.",
    "The city issues a license to every shop.",
    "All seats are reserved for guests.",
    "She has the right to a version of the story.",
    "The public library is free and open to any person.",
    "A general permission is needed to use the work.",
    "The apache helicopter flew under the bridge.",
    "Students of MIT published a paper.",
    "Copies of the source are in the file.",
]
UNKNOWN = "unknown"
ALIKE, PAIRED = 0.6, 0.4
WIDE, STEP, NARROW, LINES = 80, 40, 30, 6
_SPLIT = "[^a-z0-9]+"


def word_list(text: str) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(_SPLIT, folded) if w]


def pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def grams(words: list[str]) -> list[str]:
    """Distinct words and neighbouring pairs."""
    return list(dict.fromkeys(words + pairs(words)))


def templates(notices: dict[str, list[str]]) -> list[list[tuple[list[str], list[str]]]]:
    """By family, the distinct words and pairs of its notices."""
    return [[(sorted(set(w)), sorted(set(pairs(w)))) for w in map(word_list, own)] for own in notices.values()]


@dataclass
class Model:
    classes: list[str]  # families, then UNKNOWN
    telling: list[str]  # words one of which a scored segment must hold
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    offset: float  # of unknown, after the temperature
    templates: list[list[tuple[list[str], list[str]]]]

    def predict(self, words: list[str], least: float, alike: float) -> tuple[str, float, float]:
        """What the columns compute, for one segment: class, probability, likeness to the closest notice."""
        if not set(words) & set(self.telling):
            return UNKNOWN, 1.0, 0.0
        z = np.array(self.bias)
        for g in grams(words):
            z = z + np.array(self.weights.get(g, np.zeros(len(z))))
        z = z / self.temperature
        z[-1] += self.offset
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        if k == len(self.templates) or p[k] < least:
            return UNKNOWN, float(p[k]), 0.0
        have, both = set(words), set(pairs(words))
        likeness = max((len(set(t) & have) / len(t) for t, u in self.templates[k] if len(set(u) & both) >= PAIRED * len(u)), default=0.0)
        return (self.classes[k] if likeness >= alike else UNKNOWN), float(p[k]), likeness


def telling_words(notices: dict[str, list[str]], common: dict[str, int], alike: float = ALIKE) -> list[str]:
    """The words of each notice that are rarest in the background, one more than may be missing from a confirmed segment."""
    out: set[str] = set()
    for t in (sorted(set(word_list(t))) for own in notices.values() for t in own):
        need = next(k for k in range(len(t) + 1) if round(k / len(t), 4) >= alike)
        out.update(sorted(t, key=lambda w: (common.get(w, 0), w))[: len(t) - max(need, 1) + 1])
    return sorted(out)


def _examples(notices: dict[str, list[str]], filler: list[str], variants: int, rng: random.Random) -> list[tuple[list[str], int]]:
    """Notices with words dropped and other text around them, and their families."""
    rows = []
    for k, own in enumerate(notices.values()):
        for words in map(word_list, own):
            for v in range(variants):
                kept = [w for w in words if v == 0 or rng.random() > (0.08 if len(words) > 6 else 0.0)]
                around = [rng.choice(filler) for _ in range(rng.choice([0, 0, 2, 6, 15, 60]))] if v else []
                cut = rng.randrange(len(around) + 1)
                rows.append((around[:cut] + kept + around[cut:], k))
    return rows


def _regression(rows: list[tuple[list[str], int]], vocabulary: dict[str, int], classes: int, rounds: int) -> np.ndarray:
    """Weights of the grams, the last row being the bias."""
    w, velocity = np.zeros((len(vocabulary) + 1, classes)), np.zeros((len(vocabulary) + 1, classes))
    x = _matrix([r for r, _ in rows], vocabulary)
    active = x[:, :-1].any(1)  # a segment with no gram of the vocabulary moves nothing but the bias
    x, y = x[active], np.eye(classes)[np.array([k for _, k in rows])[active]]
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        velocity = 0.9 * velocity - 1.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)
        w += velocity
    return w


def _matrix(segments: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(segments), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for i, words in enumerate(segments):
        x[i, [vocabulary[g] for g in grams(words) if g in vocabulary]] = 1
    return x


def fit(background: list[str], variants: int = 30, rounds: int = 200, seed: int = 5) -> Model:
    rng, known = random.Random(seed), templates(NOTICES)
    looks = lambda w: max(len(set(t) & set(w)) / len(t) for own in known for t, _ in own) >= 0.6
    plain = [w[:WIDE] for w in map(word_list, background) if w and not looks(w)]
    filler = [w for words in plain[:2000] for w in words] or ["lorem", "ipsum"]
    common: dict[str, int] = {}
    for words in plain:
        for w in set(words):
            common[w] = common.get(w, 0) + 1
    stop = {w for w, n in common.items() if n > 0.002 * len(plain) + 1} | {"the", "of", "to", "and", "a", "in", "is", "it", "be", "by", "or", "any", "this", "that", "for", "with", "you", "at", "may", "not", "as", "are"}
    marks = sorted({w for own in known for t, _ in own for w in t if len(w) > 1 and not w.isdigit()} - stop)
    unknown, wrong = len(NOTICES), list(map(word_list, MISUSES))
    others = [(w, unknown) for w in plain]
    for _ in range(60):
        others += [(m + [rng.choice(filler) for _ in range(rng.choice([0, 3, 8, 60]))], unknown) for m in wrong]
        others.append(([rng.choice(filler) for _ in range(8)] + rng.sample(marks, min(2, len(marks))), unknown))
    names = {g for own in NOTICES.values() for t in own for g in grams(word_list(t))} | {g for m in wrong for g in grams(m)}
    vocabulary = {g: i for i, g in enumerate(sorted(names))}
    logits, truth = [], []
    for half in (0, 1):
        seen = {f: own[half::2] for f, own in NOTICES.items()}
        apart = {f: own[1 - half :: 2] for f, own in NOTICES.items()}
        w = _regression(_examples(seen, filler, variants, rng) + others[half::2], vocabulary, unknown + 1, rounds)
        held = _examples(apart, filler, 5, rng) + others[1 - half :: 2]
        logits.append(_matrix([r for r, _ in held], vocabulary) @ w)
        truth += [k for _, k in held]
    z, truth = np.concatenate(logits), np.array(truth)

    def loss(t: float, offset: float) -> float:
        s = z / t
        s[:, -1] += offset
        s = s - s.max(1, keepdims=True)
        return float(-(s - np.log(np.exp(s).sum(1, keepdims=True)))[np.arange(len(s)), truth].mean())

    temperature, offset = min(((t, o) for t in (0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 2.5, 3.0) for o in (-1.0, -0.5, 0.0, 0.5, 1.0, 1.5)), key=lambda x: loss(*x))
    w = _regression(_examples(NOTICES, filler, variants, rng) + others, vocabulary, unknown + 1, rounds)
    return Model([*NOTICES, UNKNOWN], telling_words(NOTICES, common), {g: np.round(w[i], 6).tolist() for g, i in vocabulary.items()}, np.round(w[-1], 6).tolist(), temperature, offset, known)


def train(docs: DataFrame, background: int = 3000, from_docs: int = 1000, longest: int = 4000) -> Model:
    """docs: doc_id, text. Background are at most `background` lines of at most `longest` characters from the `from_docs`
    documents of smallest hashed id."""
    chosen = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(from_docs).distinct()
    lines = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(1, longest))
    return fit([r.line for r in lines.distinct().orderBy(F.xxhash64("line"), "line").limit(background).collect()])


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _segments(lines: Column, telling: list[str]) -> Column:
    """From the words of the lines the segments that hold a telling word: first and last line, words."""
    tells = lambda words: F.exists(words, lambda w: w.isin(telling))
    segment = lambda first, last, words: F.struct(first.cast("int").alias("line"), last.cast("int").alias("last"), words.alias("w"))
    starts = lambda words: F.when(F.size(words) <= WIDE, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size(words) - STEP, F.lit(STEP)))
    single = F.flatten(F.transform(lines, lambda words, i: F.when(tells(words), F.transform(starts(words), lambda k: segment(i, i, F.slice(words, k, WIDE)))).otherwise(F.array().cast("array<struct<line:int,last:int,w:array<string>>>"))))
    narrow = lambda words: (F.size(words) > 0) & (F.size(words) <= NARROW)

    def joined(words: Column, i: Column) -> Column:
        own = F.slice(lines, i + 1, LINES)
        stop = F.array_position(F.transform(own, lambda x: ~narrow(x)), F.lit(True)).cast("int")
        n = F.when(stop == 0, F.size(own)).otherwise(stop - 1)
        return F.when(n > 1, segment(i, i + n - 1, F.slice(F.flatten(F.slice(own, 1, n)), 1, WIDE)))

    wrapped = F.filter(F.transform(lines, joined), lambda s: s.isNotNull())
    return F.filter(F.concat(single, wrapped), lambda s: tells(s["w"]))


def license_scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, alike: float = 0.6) -> DataFrame:
    """doc_id, n_paragraphs (lines), scored (segments with a telling word) and found: (line, last, family, probability, likeness) of
    the confirmed ones."""
    n = len(model.classes)
    # constants of the plan; their size is that of the vocabulary of the notices
    weights, words_of = _literal(model.weights, "map<string,array<double>>"), _literal([[t for t, _ in own] for own in model.templates], "array<array<array<string>>>")
    pairs_of, vocabulary = _literal([[u for _, u in own] for own in model.templates], "array<array<array<string>>>"), F.lit(sorted(model.weights)).cast("array<string>")
    telling = model.telling if alike >= ALIKE else sorted({w for own in model.templates for t, _ in own for w in t})
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda p: F.filter(F.split(F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _SPLIT), lambda w: w != ""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.size(F.split(text, "\n")).cast("long").alias("n_paragraphs"), lines.alias("lines"))
    some = F.exists("lines", lambda words: F.exists(words, lambda w: w.isin(telling)))
    rows = rows.withColumn("lines", F.when(some, F.col("lines")).otherwise(F.array().cast("array<array<string>>")))
    rows = rows.select("doc_id", "n_paragraphs", F.when(F.size("lines") > 0, _segments(F.col("lines"), telling)).otherwise(F.array().cast("array<struct<line:int,last:int,w:array<string>>>")).alias("c"))
    pair = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    bias = F.array(*(F.lit(b) for b in model.bias))
    place = lambda s: (s["line"].alias("line"), s["last"].alias("last"), s["w"].alias("w"))
    rows = rows.withColumn("c", F.transform("c", lambda s: F.struct(*place(s), F.array_intersect(F.concat(s["w"], pair(s["w"])), vocabulary).alias("g"))))
    rows = rows.withColumn("c", F.transform("c", lambda s: F.struct(*place(s), F.aggregate(s["g"], bias, lambda z, g: F.zip_with(z, F.element_at(weights, g), lambda a, b: a + b)).alias("z"))))
    rows = rows.withColumn("c", F.transform("c", lambda s: F.struct(*place(s), F.transform(s["z"], lambda z, i: z / model.temperature + F.when(i == n - 1, model.offset).otherwise(0.0)).alias("z"))))
    rows = rows.withColumn("c", F.transform("c", lambda s: F.struct(*place(s), F.transform(s["z"], lambda z: F.exp(z - F.array_max(s["z"]))).alias("e"))))
    rows = rows.withColumn("c", F.transform("c", lambda s: F.struct(*place(s), F.array_position(s["e"], F.lit(1.0)).cast("int").alias("k"), (1.0 / F.aggregate(s["e"], F.lit(0.0), lambda a, v: a + v)).alias("p"))))
    names = F.array(*(F.lit(c) for c in model.classes))

    def likeness(s: Column) -> Column:
        share = lambda own, have: F.size(F.array_intersect(own, have)) / F.size(own)
        each = F.zip_with(words_of[s["k"] - 1], pairs_of[s["k"] - 1], lambda t, u: F.when((F.size(u) == 0) | (F.size(F.array_intersect(u, pair(s["w"]))) >= PAIRED * F.size(u)), share(t, s["w"])).otherwise(0.0))
        return F.array_max(each)

    rows = rows.withColumn("f", F.filter("c", lambda s: (s["k"] < n) & (s["p"] >= least)))
    rows = rows.withColumn("f", F.transform("f", lambda s: F.struct(s["line"].alias("line"), s["last"].alias("last"), names[s["k"] - 1].alias("family"), F.round(s["p"], 4).alias("probability"), F.round(likeness(s), 4).alias("likeness"))))
    rows = rows.withColumn("f", F.array_sort(F.array_distinct(F.filter("f", lambda s: s["likeness"] >= alike))))
    better = lambda a, b: (a["likeness"] > b["likeness"]) | ((a["likeness"] == b["likeness"]) & ((a["last"] - a["line"] < b["last"] - b["line"]) | ((a["last"] - a["line"] == b["last"] - b["line"]) & ((a["line"] < b["line"]) | ((a["line"] == b["line"]) & (a["probability"] > b["probability"]))))))
    meets = lambda a, b: (a["family"] == b["family"]) & (a["line"] <= b["last"]) & (b["line"] <= a["last"])
    found = F.filter("f", lambda s: ~F.exists("f", lambda o: meets(o, s) & better(o, s)))
    return rows.select("doc_id", "n_paragraphs", F.size("c").cast("long").alias("scored"), found.alias("found"))


QUERY = "op5_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan(docs, train(docs))
    return found.select("doc_id", "n_paragraphs", "scored", F.size("found").cast("long").alias("n_licences"), F.array_sort(F.array_distinct("found.family")).alias("families"), F.col("found.line").alias("lines"), F.array_max("found.probability").alias("probability"))


ORACLE_SQL = None
