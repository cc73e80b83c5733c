"""Licence families of paragraphs by a trained classifier, in DataFrame operations only.

A sparse logistic regression over word n-grams (one to three words) is fitted on the driver from the fixed notices
below and a few everyday sentences that use the same words for other things. Its unknown class is calibrated on
held-out folds: the temperature makes the probabilities of held-out notices true, and a family is predicted only if its
probability reaches CONFIDENT. Paragraphs are scored in overlapping windows of words, so that a notice counts alike in
a line of its own and inside a long paragraph, wrapped over lines or not. Scoring is a join of a window's n-grams with
the weights, and each prediction must be confirmed by a template of its family, of whose word pairs the window has the
share CONFIRM.

From that share follows which texts need scoring at all: a window that confirms a template has one of any choice of more
than 1 - CONFIRM of its pairs. The words of such a choice, taken from the templates themselves, are what is looked for.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import keyed_text, table

#: Public licence notices and identifiers, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License. See LICENSE for more information.",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This software is released under the Apache License 2.0.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND',
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL version 2 or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is distributed under the LGPL.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "To the extent possible under law, the author has waived all copyright under Creative Commons Zero, CC0 1.0.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
        "Released under the terms of the ISC license.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose",
        "Released into the public domain under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "Copyright 2020. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Subject to the terms of a commercial license agreement.",
    ],
}
UNKNOWN = "unknown"
#: Sentences with the same words that are no licence.
OTHERS = [
    "He lost his driving license and had to take the bus.", "The restaurant was granted a license to serve wine.", "She asked for permission to leave the room.",
    "The public library is open on Sunday.", "The general told the public about the terms of the peace.", "A copy of the letter was found in the house.",
    "The terms of the agreement were discussed in public.", "They work under the terms of a contract.", "This version of the story is shorter than the first.",
    "The house is free of charge for the first month.", "The price of the fishing license has gone up this year.", "The program was released in the spring.",
    "The apache helicopter landed near the river.", "Students at MIT work on robots.", "Copyright law is taught in the second year.",
    "The software was late and the users were not told.", "All people have rights.", "He has the right to use the public road.", "The source of the river is in the hills.",
    "With or without you the work goes on.", "Distributed systems are hard to test.", "Please see the file for more information.", "A general license for hunting is sold at the station.",
]
NGRAMS, EPOCHS, RATE, RIDGE = 3, 60, 0.3, 0.002
#: Least probability of a family, and least share of a template's word pairs that confirms it.
CONFIDENT, CONFIRM = 0.6, 0.6
#: Words of a window and between the starts of windows; templates are compared in pieces of at most PIECE words.
WINDOW, STEP, PIECE = 24, 12, 13
WORD = r"[a-z#]+"
#: Common English words; others are looked for first.
EVERYDAY = frozenset("a about above after all also an and any are as at be been but by can could do does first following for from had has have he her his how if in into is it its made may more most my new no not now of on one only or other our out over shall should so some such than that the their them then there these they this those to up was we were what when which who will with within without would you your under".split())
#: Paragraphs end at blank lines.
BLANK_LINE = r"\r?\n[\x20\t]*\r?\n"


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case, each digit as #."""
    return re.findall(WORD, re.sub("[0-9]", "#", text.lower()))


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1)}


def pairs(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}  # noqa: B905


def pieces(text: str) -> list[list[str]]:
    """The text's words in pieces of at most PIECE words, of about equal lengths."""
    words = words_of(text)
    n = -(-len(words) // PIECE)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


@functools.cache
def templates() -> list[tuple[str, int, frozenset[str]]]:
    """family, number within the family, and the word pairs of each piece of a notice."""
    return [(family, i, frozenset(pairs(p))) for family, texts in TEMPLATES.items() for i, t in enumerate(texts) for p in pieces(t)]


@functools.cache
def telling_words() -> list[str]:
    """Words of which every window has one that confirms any template: of each template's pairs the most telling ones,
    more than the share that may be missing, and of each of these its more telling word. Which they are matters for
    speed alone."""
    telling = lambda w: (w not in EVERYDAY and w.strip("#") != "", len(w), w)
    out = set()
    for _, _, own in templates():
        best = sorted((max(map(telling, p.split())) for p in own), reverse=True)
        out |= {w for _, _, w in best[: math.floor((1 - CONFIRM) * len(own) + 1e-9) + 1]}
    return sorted(out)


def telling_pattern() -> str:
    """telling_words as one pattern, branched by first letters."""
    by_letter: dict[str, list[str]] = {}
    for w in telling_words():
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]).replace("\\#", "[0-9]").replace("#", "[0-9]"))
    branches = "|".join((letter if letter != "#" else "[0-9]") + f"(?:{'|'.join(rest)})" for letter, rest in sorted(by_letter.items()))
    return rf"(?i)(?<![a-z0-9])(?:{branches})(?![a-z0-9])"


def _fit(samples: list[tuple[set[str], int]], classes: int) -> list[dict[str, float]]:
    """Weights of each class by stochastic gradient descent with weight decay; gram "" is the intercept."""
    weights: list[dict[str, float]] = [{} for _ in range(classes)]
    order, rng = list(range(len(samples))), random.Random(5)
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = RATE / (1 + epoch / 10)
        for s in order:
            own, label = samples[s]
            scale = 1 / math.sqrt(len(own) + 1)
            p = _softmax([sum(w.get(g, 0.0) for g in own) * scale + w.get("", 0.0) for w in weights])
            for k, w in enumerate(weights):
                step = rate * ((k == label) - p[k])
                for g in own:
                    w[g] = w.get(g, 0.0) * (1 - rate * RIDGE) + step * scale
                w[""] = w.get("", 0.0) + step * 0.1
    return weights


def _softmax(z: list[float]) -> list[float]:
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def _scores(own: set[str], weights: list[dict[str, float]]) -> list[float]:
    """Logits of a text's n-grams; those that no weight knows do not count for its length."""
    known = [g for g in own if any(g in w for w in weights)]
    return [sum(w.get(g, 0.0) for g in known) / math.sqrt(len(known) + 1) + w.get("", 0.0) for w in weights]


@functools.cache
def model() -> tuple[list[str], list[dict[str, float]], float, list[tuple[list[float], int]]]:
    """Classes, their weights, the temperature that gives held-out samples the greatest likelihood, and these samples'
    logits and labels."""
    names = [*TEMPLATES, UNKNOWN]
    texts = [(t, k) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family]] + [(t, len(names) - 1) for t in OTHERS]
    samples = [(grams(words_of(t)), k) for t, k in texts]
    held = []
    for fold in range(4):
        weights = _fit([s for i, s in enumerate(samples) if i % 4 != fold], len(names))
        held += [(_scores(own, weights), label) for own, label in (s for i, s in enumerate(samples) if i % 4 == fold)]
    loss = lambda t: -sum(math.log(_softmax([x / t for x in z])[label] + 1e-12) for z, label in held)
    temperature = min((0.25 * 1.2**i for i in range(20)), key=loss)
    return names, _fit(samples, len(names)), temperature, held


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each family that a paragraph has a confirmed licence of: doc_id, paragraph (from 0; they end at blank
    lines), family, probability, template (its number within the family), share (of the template's word pairs) and word
    (the first one of the window, from 0), of the best window of that family.

    A null or empty text has none; repeated rows have theirs each, a null doc_id stays null; other columns are not
    read; an empty table gives no rows. Equal probabilities and shares go to the first in order.
    """
    names, weights, temperature, _ = model()
    spark = docs.sparkSession
    pattern = telling_pattern()
    rows = keyed_text(docs, id_col, text_col).where(F.col("text").rlike(pattern)).withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("row", "doc_id", F.posexplode(F.split("text", BLANK_LINE, -1)).alias("paragraph", "part")).where(F.col("part").rlike(pattern))
    parts = parts.select("row", "doc_id", "paragraph", F.regexp_extract_all(F.translate(F.lower("part"), "0123456789", "##########"), F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - F.lit(WINDOW - STEP + 1), F.lit(0)), F.lit(STEP))
    windows = parts.select("row", "doc_id", "paragraph", "w", F.explode(starts).alias("word")).select("row", "doc_id", "paragraph", "word", F.slice("w", F.col("word") + 1, F.lit(WINDOW)).alias("w"))
    windows = windows.where(F.arrays_overlap("w", F.array(*[F.lit(w) for w in telling_words()])))
    # Windows of three words; each gives its one, two and three words.
    shifted = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))
    keys = ["row", "doc_id", "paragraph", "word"]
    each = windows.select(*keys, F.explode(shifted).alias("t")).select(*keys, F.explode(F.array(F.col("t.a"), F.concat_ws(" ", "t.a", "t.b"), F.concat_ws(" ", "t.a", "t.b", "t.c"))).alias("gram"))
    # Tables of the fixed notices only: their size does not depend on the data.
    vocabulary = sorted({g for w in weights for g in w if g})
    table_w = spark.createDataFrame([(g, [w.get(g, 0.0) for w in weights]) for g in vocabulary], "gram string, weights array<double>")
    own = templates()
    holders: dict[str, list[int]] = {}
    for i, (_, _, p) in enumerate(own):
        for g in p:
            holders.setdefault(g, []).append(i)
    table_t = spark.createDataFrame([(g, h) for g, h in sorted(holders.items())], "gram string, holders array<int>")
    known = table_w.join(table_t, "gram", "left")
    sums = each.join(F.broadcast(known), "gram").groupBy(*keys, "gram").agg(F.first("weights").alias("weights"), F.first("holders").alias("holders"))
    per = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.get("weights", F.lit(k))).alias(f"z{k}") for k in range(len(names))],
        *[F.sum(F.coalesce(F.array_contains("holders", i).cast("int"), F.lit(0))).alias(f"t{i}") for i in range(len(own))],
    )
    logits = [(F.col(f"z{k}") / F.sqrt(F.col("n") + 1) + w.get("", 0.0)) / temperature for k, w in enumerate(weights)]
    top = F.greatest(*logits)
    per = per.withColumn("e", F.array(*[F.exp(x - top) for x in logits]))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.slice("e", 1, len(names) - 1), lambda x, k: F.struct((x / whole).alias("p"), (-k).alias("k"))))
    per = per.withColumn("best", best)
    family = F.element_at(F.array(*[F.lit(x) for x in names]), 1 - F.col("best.k"))
    shares = F.array(*[F.struct((F.col(f"t{i}") / len(p)).alias("share"), F.lit(-i).alias("i"), F.lit(f).alias("family")) for i, (f, _, p) in enumerate(own)])
    per = per.withColumn("family", family)
    match = F.array_max(F.filter(shares, lambda x: x["family"] == F.col("family")))
    numbers = F.array(*[F.lit(j) for _, j, _ in own])
    found = per.withColumn("match", match).where((F.col("best.p") >= CONFIDENT) & (F.col("match.share") >= CONFIRM))
    found = found.select("row", "doc_id", "paragraph", "family", F.struct(F.col("best.p").alias("p"), F.col("match.share").alias("share"), (-F.col("word")).alias("word"), F.element_at(numbers, 1 - F.col("match.i")).alias("template")).alias("b"))
    one = found.groupBy("row", "doc_id", "paragraph", "family").agg(F.max("b").alias("b"))
    return one.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.col("b.p").alias("probability"), F.col("b.template").alias("template"), F.col("b.share").alias("share"), (-F.col("b.word")).cast("long").alias("word"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licensed paragraphs of all documents."""
    return scan(table(spark, sf_dir, "documents"))
