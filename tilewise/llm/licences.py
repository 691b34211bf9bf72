"""Licence notices in documents, by a trained classifier of paragraphs (operator 6).

A paragraph is a line, or a passage: as many words as a template has, over line ends or within a
long line, about a word pair at the place it has in the template (once just so many, once a quarter
more at each end). Passages may begin and end in any line, so wrapping doesn't matter, and each
notice of a long line is judged by itself. Of overlapping passages the one with the largest likeness
stays; a line that is a notice as a whole is reported once for its family. A paragraph's features are its distinct word 1- to 3-grams; a multinomial logistic
regression gives the probability of each licence family and of `unknown`. It is trained on the
driver from the templates below (with words lost, added and mixed into other text) against bounded
samples: unlicensed sentences below, and at most `NEGATIVES` lines of the corpus, or pieces of long ones from anywhere in them, that aren't like a template. Weights are sparse. A
temperature fitted on held-out examples calibrates the probabilities; a paragraph is of the unknown
class unless a family reaches `LEAST_PROBABILITY`. Notices of licences outside the families (`OTHERS`) are examples of
the unknown class. A prediction stands only if the paragraph is like one of the family's templates: it
holds at least `LEAST_LIKENESS` of its word pairs, as much of their weight, where a pair weighs the less the more licences
have it, and all of the template's pairs with a number (its version). So `SPDX-License-Identifier:` and what all notices say
count for nearly nothing, and another version is another licence.

Training meets no document's decision but by its weights; finding runs on DataFrame functions
alone: of each template so many word pairs are `seeds` that a text without any of them can't reach
`LEAST_LIKENESS`; such lines are passed over before n-grams are made. The sample only says which
pairs are the rarest and so the cheapest seeds, never what is found.

Defined cases: null and empty texts have no paragraphs; repeated rows are reported each; ties go
to the family first in alphabetical order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import sampled

UNKNOWN = "unknown"
NEGATIVES, LEAST_PROBABILITY, LEAST_LIKENESS = 2_000, 0.5, 0.6
MOST_GRAM = 3
#: Lines of the corpus with this share of a template's word pairs could be (part of) a notice: they aren't taken as negatives.
NEGATIVE_LIKENESS = 0.3
#: Signs of a line that are learned from at once; a longer line is cut into pieces, each of which may be in the sample.
PIECE = 2_000

# Short public notices of licences.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU General Public License, Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU General Public License, Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published",
        "GNU Lesser General Public License as published by the Free Software Foundation; version 2.1",
        "GNU Lesser General Public License, Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# Short public notices of licences that are no family here.
OTHERS = {
    "AFL-3.0": ["Licensed under the Academic Free License version 3.0", "SPDX-License-Identifier: AFL-3.0"],
    "Apache-1.1": ["Licensed under the Apache Software License, Version 1.1.", "Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: Apache-1.1"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "BSD-4-Clause": ["SPDX-License-Identifier: BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "BUSL-1.1": ["Use of this software is governed by the Business Source License", "Licensed under the Business Source License 1.1", "SPDX-License-Identifier: BUSL-1.1"],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "CDDL-1.0": ["The contents of this file are subject to the terms of the Common Development and Distribution License", "SPDX-License-Identifier: CDDL-1.0"],
    "EPL-1.0": ["Licensed under the Eclipse Public License, version 1.0.", "SPDX-License-Identifier: EPL-1.0"],
    "EUPL-1.2": ["Licensed under the European Union Public Licence, Version 1.2", "SPDX-License-Identifier: EUPL-1.2"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation", "SPDX-License-Identifier: GFDL-1.3-or-later"],
    "GPL-1.0": ["This work is licensed under the GNU General Public License, version 1.", "SPDX-License-Identifier: GPL-1.0-or-later"],
    "MIT-0": ["Released under the MIT No Attribution License.", "Licensed under the MIT-0 License.", "SPDX-License-Identifier: MIT-0"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "Licensed under the Mozilla Public License, Version 1.1.", "SPDX-License-Identifier: MPL-1.1"],
    "MS-PL": ["Licensed under the Microsoft Public License.", "SPDX-License-Identifier: MS-PL"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SPDX-License-Identifier: OFL-1.1"],
    "OSL-3.0": ["Licensed under the Open Software License version 3.0", "SPDX-License-Identifier: OSL-3.0"],
    "Python-2.0": ["Licensed under the Python Software Foundation License Version 2", "SPDX-License-Identifier: Python-2.0"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty.", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"],
}
NOT_LICENCES = [
    "You need a driver's license to rent a car.",
    "The restaurant lost its license to serve alcohol last year.",
    "She is a licensed physician and works in the general hospital.",
    "All rights reserved.",
    "The software was released to the public in March.",
    "He was released on bail under strict conditions.",
    "Permission to land was granted by the tower.",
    "The Apache helicopter flew over the base.",
    "MIT and Harvard published a study on this.",
    "This work is a version of the general plan.",
    "The creative team met under the old bridge at noon.",
    "Source and binary files are kept in the archive.",
    "Commons and lords voted on the public domain bill.",
    "The licence fee is due on the first of the month.",
]


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(ws: list[str], most: int = MOST_GRAM) -> list[str]:
    return sorted({" ".join(ws[i : i + n]) for n in range(1, most + 1) for i in range(len(ws) - n + 1)})


def pairs(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + 2]) for i in range(len(ws) - 1)}


@functools.cache
def _template_pairs(family: str) -> list[set[str]]:
    return [pairs(words(t)) for t in TEMPLATES[family]]


def likeness(text: str) -> float:
    """The largest share of a template's word pairs that `text` holds."""
    own = pairs(words(text))
    return max(len(own & ps) / len(ps) for family in TEMPLATES for ps in _template_pairs(family))


@functools.cache
def _weights() -> dict[str, float]:
    """What each word pair of the templates says about whose it is: 1 over the number of licences that have it."""
    uses = Counter(p for ts in (*TEMPLATES.values(), *OTHERS.values()) for p in set().union(*(pairs(words(t)) for t in ts)))
    return {p: 1 / n for p, n in uses.items()}


def _numbered(own: set[str]) -> set[str]:
    """The pairs with a number: a template's version."""
    return {p for p in own if any(c.isdigit() for c in p)}


def is_like(text: str, family: str) -> bool:
    """Whether a text is like one of a family's templates."""
    own, weight = pairs(words(text)), _weights()
    heavy = lambda ps: sum(weight[p] for p in ps)
    return any(len(own & ps) >= LEAST_LIKENESS * len(ps) and heavy(own & ps) >= LEAST_LIKENESS * heavy(ps) - 1e-12 and _numbered(ps) <= own for ps in _template_pairs(family))


def rarest_seeds(template: str, uses: Counter[str]) -> set[str]:
    """So many pairs of `template`, the rarest first, that no text without any of them holds `LEAST_LIKENESS` of its pairs."""
    own = pairs(words(template))
    least = next(k for k in range(len(own) + 1) if k / len(own) >= LEAST_LIKENESS)
    rank = lambda p: (uses[p], min(uses[w] for w in p.split()), sum(uses[w] for w in p.split()), p)
    return set(sorted(own, key=rank)[: len(own) - least + 1])


@dataclass
class Model:
    families: list[str]  # without the unknown class, whose scores come last
    weights: dict[str, list[float]]
    bias: list[float]
    seeds: list[str]

    def probabilities(self, text: str) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(words(text)) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(negatives: list[str], rng: np.random.Generator) -> tuple[list[list[str]], list[int]]:
    """Templates as they are, with words lost, words added, and inside other text; and what isn't a licence."""
    families, texts, classes = sorted(TEMPLATES), [], []
    other = [w for t in negatives for w in words(t)] or ["text"]
    for k, family in enumerate(families):
        for template in TEMPLATES[family]:
            ws = words(template)
            for turn in range(24):
                own = list(ws)
                if turn % 4 == 1:
                    own = [w for w in own if rng.random() > 0.1] or own
                if turn % 4 == 2:
                    for _ in range(1 + len(own) // 10):
                        own.insert(int(rng.integers(len(own) + 1)), str(rng.choice(other)))
                if turn % 4 == 3:
                    a, b = rng.integers(0, 30, 2)
                    own = [*map(str, rng.choice(other, a)), *own, *map(str, rng.choice(other, b))]
                texts.append(own)
                classes.append(k)
    for t in negatives + NOT_LICENCES * 20 + [t for ts in OTHERS.values() for t in ts] * 12:
        texts.append(words(t))
        classes.append(len(families))
    return texts, classes


def fit(negatives: list[str], rounds: int = 150, decay: float = 1e-4, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    texts, classes = _examples(negatives, rng)
    features = sorted({g for ts in (*TEMPLATES.values(), *OTHERS.values()) for t in ts for g in grams(words(t))})
    number = {g: i for i, g in enumerate(features)}
    x = np.zeros((len(texts), len(features) + 1))
    x[:, -1] = 1
    for i, ws in enumerate(texts):
        x[i, [number[g] for g in grams(ws) if g in number]] = 1
    y = np.array(classes)
    held = rng.random(len(y)) < 0.2
    a, target = x[~held].astype(np.float32), np.eye(len(families) + 1, dtype=np.float32)[y[~held]]
    weigh = 1 / np.maximum(1, target.sum(axis=0))
    share = (target @ weigh)[:, None] / len(weigh)
    share, w = share.astype(np.float32), np.zeros((x.shape[1], len(families) + 1), np.float32)
    pace, gone = np.zeros_like(w), 0.9
    step = 20.0
    for _ in range(rounds):
        z = a @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pace = gone * pace - step * (a.T @ ((p - target) * share) + decay * w)
        w += pace
    w = w.astype(float)
    w[:-1][np.abs(w[:-1]).max(axis=1) < 1e-3] = 0  # sparse

    def loss(heat: float) -> float:
        z = x[held] @ w / heat
        z -= z.max(axis=1, keepdims=True)
        return float(-(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(held.sum()), y[held]].mean())

    heat = min(np.geomspace(0.3, 4, 30), key=loss) if held.any() else 1.0
    w = np.round(w / heat, 6)
    kept = [i for i in range(len(features)) if w[i].any()]
    uses = Counter(g for t in negatives + NOT_LICENCES for g in grams(words(t), 2))
    seeds = sorted(set().union(*(rarest_seeds(t, uses) for ts in TEMPLATES.values() for t in ts)))
    return Model(families, {features[i]: w[i].tolist() for i in kept}, w[-1].tolist(), seeds)


def train(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    """Fits against a bounded sample of lines, long ones in pieces of `PIECE` signs: one, by a hash, of all those of each of the documents
    with the smallest hash of doc_id. A sampled line that is like a template, or has a word that mostly notices have, is left out: it could be one."""
    pieces = lambda t: F.when(F.length(t) <= PIECE, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    line = F.array_min(F.transform(F.flatten(F.transform(F.split("text", "\n"), pieces)), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t"))))
    single = docs.select("doc_id", "text").where("text IS NOT NULL").select("doc_id", line["t"].alias("t"))
    lines = sorted(r["t"] for r in sampled(single, "doc_id", negatives, docs.count()).collect() if r["t"])
    rare = {w for ts in TEMPLATES.values() for t in ts for w in words(t)} & {"license", "licensed", "apache", "gnu", "mit", "bsd", "spdx", "mozilla", "redistribution", "unencumbered", "cc", "creative"}
    return fit([t for t in lines if not rare.intersection(words(t)) and likeness(t) < NEGATIVE_LIKENESS])


def _doubles(xs: list[float]) -> Column:
    return F.array(*map(F.lit, xs))


def _constant(value, kind: str) -> Column:
    """A value of a nested type, which the optimizer makes a literal: thousands of literals one by one take seconds to plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


#: What `_words` takes for words, in a text that isn't lower-cased: the Kelvin sign becomes a k, a capital i with a dot an i and a sign.
_LETTER = "A-Za-z0-9\u212a"
_WORD = f"(?:[{_LETTER}]*\u0130|[{_LETTER}]+)"


def _spelled(text: Column) -> Column:
    """The words of a text as it has them, each with the signs up to the next one."""
    return F.regexp_extract_all(text, F.lit(f"{_WORD}[^{_LETTER}\u0130]*"), F.lit(0))


def _ngrams(ws: Column, n: int) -> Column:
    whole = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))
    return F.when(F.size(ws) >= n, whole).otherwise(F.array().cast("array<string>"))


def _any_pair(seeds: list[str]) -> str:
    """A pattern for a text with one of the word pairs; words stand between signs that aren't letters or digits."""
    after: dict[str, dict[str, list[str]]] = {}
    for first, second in map(str.split, seeds):
        after.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    pair = lambda ends: "|".join(f"{end}[^a-z0-9]++(?:{'|'.join(seconds)})" for end, seconds in sorted(ends.items()))
    return f"(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{pair(ends)})' for c, ends in sorted(after.items()))})(?![a-z0-9])"


def _passages(lines: Column, seeds: list[str]) -> Column:
    """The passages of a text's lines that hold `LEAST_LIKENESS` of a template's word pairs, wherever lines end: struct(first
    and last line, a and b: its words' places in the text, ws)."""
    given = [t for k in sorted(TEMPLATES) for t in TEMPLATES[k]]
    templates = [words(t) for t in given]
    spans: dict[str, list[tuple[int, int, int]]] = {s: [] for s in seeds}  # words before and from the seed on, template
    for k, t in enumerate(templates):
        # an SPDX line stands by itself, and its name must not be cut; what begins with a small letter is part of a notice
        for i in range(0 if t[0] == "spdx" or given[k][0].islower() else len(t) - 1):
            for more in {0, len(t) // 4}:
                spans.get(f"{t[i]} {t[i + 1]}", []).append((i + more, len(t) - i + more, k))
    named = {s: [dict(zip(("before", "after", "template"), x)) for x in own] for s, own in spans.items()}
    table = _constant(named, "map<string,array<struct<before:int,after:int,template:int>>>")
    every = _constant([sorted(pairs(t)) for t in templates], "array<array<string>>")
    least = _constant([len(pairs(t)) * LEAST_LIKENESS for t in templates], "array<double>")

    def among(ws: Column) -> Column:
        pair = lambda i: F.concat_ws(" ", F.get(ws, i)["w"], F.get(ws, i + 1)["w"])
        at = F.filter(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: pair(i).isin(seeds))

        def code(i: Column, s: Column) -> Column:  # one number for each passage, as numbers are made distinct by hashing
            a = F.greatest(i - s["before"], F.lit(0))
            return (a.cast("long") * 256 + F.least(i + s["after"], F.size(ws)) - a) * 256 + s["template"]

        codes = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.element_at(table, pair(i)), lambda s: code(i, s)))))

        def passage(c: Column) -> Column:
            a, n = F.shiftright(c, 16).cast("int"), (F.shiftright(c, 8) % 256).cast("int")
            own = F.transform(F.slice(ws, a + 1, n), lambda w: w["w"])
            return F.struct(F.get(ws, a)["line"].alias("first"), F.get(ws, a + n - 1)["line"].alias("last"), a.alias("a"), (a + n).alias("b"), own.alias("ws"), (c % 256).cast("int").alias("template"))

        like = lambda p: F.size(F.array_intersect(_ngrams(p["ws"], 2), F.get(every, p["template"]))) >= F.get(least, p["template"])
        return F.transform(F.filter(F.transform(codes, passage), like), lambda p: F.struct(*(p[k].alias(k) for k in ("first", "last", "a", "b", "ws"))))

    return _let(F.flatten(F.transform(lines, lambda t, i: F.transform(_words(t), lambda w: F.struct(w.alias("w"), i.alias("line"))))), among)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The licence paragraphs of `docs` (doc_id, text): doc_id, paragraph (its first line, from 0), family, probability,
    likeness, paragraph_text (of a passage the text from its first word to its last, wherever in the document it is)."""
    model = model or train(docs)
    seed = _any_pair(model.seeds)
    some = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(F.lower("text").rlike(seed))
    some = some.select("doc_id", F.split("text", "\n").alias("lines"))
    keys = list(model.weights)
    table = _constant({k: list(map(float, model.weights[k])) for k in keys}, "map<string,array<double>>")
    every = _constant(keys, "array<string>")
    weight = _weights()
    known_templates = [{"family": k + 1, "ps": sorted(ps), "least": LEAST_LIKENESS * sum(weight[p] for p in ps) - 1e-12, "numbers": sorted(_numbered(ps))} for k, f in enumerate(model.families) for ps in _template_pairs(f)]
    templates = _constant(known_templates, "array<struct<family:int,ps:array<string>,least:double,numbers:array<string>>>")
    weights = _constant(weight, "map<string,double>")
    add = lambda total, g: F.zip_with(total, F.element_at(table, g), lambda a, b: a + b)

    def softmax(z: Column) -> Column:
        top = F.array_max(z)
        best = F.array_position(z, top).cast("int").alias("best")
        return F.struct(best, (1 / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))).alias("probability"))

    def classified(ws: Column) -> Column:
        known = F.array_intersect(F.concat(*(_ngrams(ws, n) for n in range(1, MOST_GRAM + 1))), every)  # distinct
        return _let(F.aggregate(known, _doubles(model.bias), add), softmax)

    def alike(best: Column, ws: Column) -> Column:
        """The largest share of the pairs of one of the family's templates, 0 where none of them is like the words."""

        def share(t: Column, own: Column) -> Column:
            held = F.array_intersect(own, t["ps"])
            heavy = F.aggregate(held, F.lit(0.0), lambda s, p: s + F.element_at(weights, p))
            whole = F.size(F.array_intersect(own, t["numbers"])) == F.size(t["numbers"])
            return F.when(whole & (heavy >= t["least"]), F.size(held) / F.size(t["ps"])).otherwise(F.lit(0.0))

        shares = lambda own: F.transform(F.filter(templates, lambda t: t["family"] == best), lambda t: share(t, own))
        return F.coalesce(F.array_max(_let(_ngrams(ws, 2), shares)), F.lit(0.0))  # of the unknown class there are no templates

    def scored(unit: Column) -> Column:
        return _let(classified(unit["ws"]), lambda c: F.struct((-alike(c["best"], unit["ws"])).alias("unlike"), F.size(unit["ws"]).alias("n"), (-c["probability"]).alias("unsure"), *(unit[k].alias(k) for k in ("first", "last", "a", "b")), c["best"].alias("best")))

    sure = lambda h: (h["best"] <= len(model.families)) & (h["unsure"] <= -LEAST_PROBABILITY) & (h["unlike"] <= -LEAST_LIKENESS)
    single = F.filter(F.transform("lines", lambda t, i: F.struct(i.alias("first"), i.alias("last"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), t.alias("t"))), lambda u: F.lower(u["t"]).rlike(seed))
    whole = F.transform(single, lambda u: F.struct(*(u[k].alias(k) for k in ("first", "last", "a", "b")), _words(u["t"]).alias("ws")))
    units = some.select("doc_id", "lines", F.concat(whole, _passages(F.col("lines"), model.seeds)).alias("units"))
    hits = units.select("doc_id", "lines", F.filter(F.transform("units", scored), sure).alias("hits")).where(F.size("hits") > 0)
    own = hits.select("doc_id", "lines", F.filter("hits", lambda h: h["a"] < 0).alias("whole"), F.array_sort(F.filter("hits", lambda h: h["a"] >= 0)).alias("parts"))
    apart = F.aggregate("parts", F.slice("parts", 1, 0), lambda kept, h: F.when(F.exists(kept, lambda k: (k["a"] < h["b"]) & (h["a"] < k["b"])), kept).otherwise(F.concat(kept, F.array(h))))
    own = own.select("doc_id", "lines", "whole", apart.alias("parts"))
    beside = F.filter("parts", lambda h: ~F.exists("whole", lambda w: (w["best"] == h["best"]) & w["first"].between(h["first"], h["last"])))
    own = own.select("doc_id", "lines", "whole", beside.alias("beside"))
    own = own.withColumn("spelled", F.when(F.size("beside") > 0, _spelled(F.array_join("lines", "\n"))))
    found = own.select("doc_id", "lines", "spelled", F.explode(F.concat("whole", "beside")).alias("h"))

    def text(h: Column) -> Column:
        begins = F.array_join(F.slice("spelled", h["a"] + 1, h["b"] - h["a"] - 1), "")
        passage = F.concat(begins, F.regexp_extract(F.get("spelled", h["b"] - 1), _WORD, 0))
        return F.when(h["a"] < 0, F.get("lines", h["first"])).otherwise(passage)

    return found.select(
        "doc_id", F.col("h.first").alias("paragraph"), F.element_at(F.array(*map(F.lit, model.families)), F.col("h.best")).alias("family"),
        (-F.col("h.unsure")).alias("probability"), (-F.col("h.unlike")).alias("likeness"), text(F.col("h")).alias("paragraph_text"),
    )
