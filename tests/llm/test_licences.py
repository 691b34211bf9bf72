import re

import pytest

from tilewise.llm import licences

# SPDX names and notices of licences outside the families, most of them in no list of the module either.
OUTSIDE = [
    "SPDX-License-Identifier: Artistic-2.0", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: QPL-1.0", "SPDX-License-Identifier: IPL-1.0", "SPDX-License-Identifier: Sleepycat",
    "SPDX-License-Identifier: NCSA", "SPDX-License-Identifier: PostgreSQL", "SPDX-License-Identifier: Vim", "SPDX-License-Identifier: WTFPL", "SPDX-License-Identifier: X11", "SPDX-License-Identifier: curl", "SPDX-License-Identifier: EUPL-1.1",
    "SPDX-License-Identifier: CECILL-2.1", "SPDX-License-Identifier: ODbL-1.0", "SPDX-License-Identifier: PHP-3.01", "SPDX-License-Identifier: RPSL-1.0", "SPDX-License-Identifier: CPAL-1.0", "SPDX-License-Identifier: SSPL-1.0", "SPDX-License-Identifier: Elastic-2.0",
    "SPDX-License-Identifier: EPL-1.0", "SPDX-License-Identifier: MPL-1.1", "SPDX-License-Identifier: Apache-1.0", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation.",
    "Licensed under the Mozilla Public License, Version 1.0.", "Licensed under the Apache License, Version 1.0.", "Licensed under the Eclipse Public License, version 1.0.", "Licensed under the PHP License, version 3.01.",
    "This software is provided 'as-is', without any express or implied warranty.", "Released under the Ruby License.", "Licensed under the Q Public License, Version 1.0.", "Distributed under the Boost Software License, Version 1.0.", "Released under the NTP License.",
]
INSIDE = {
    "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "SPDX-License-Identifier: LGPL-2.1-only": "LGPL", "SPDX-License-Identifier: BSD-2-Clause": "BSD", "SPDX-License-Identifier: CC-BY-4.0": "CC-BY", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "# SPDX-License-Identifier: MIT": "MIT", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991": "GPL-2.0",
    "Mozilla Public License Version 2.0\n==================================": "MPL-2.0",
}
# The public texts that stand at the head of files, or all of the licence where it is short.
WHOLE = {
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
    "MIT": """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
}


@pytest.fixture(scope="module")
def model(docs):
    return licences.train(docs)


def found(spark, model, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    out = {k: set() for k, _ in rows}
    for r in licences.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        out[r["doc_id"]].add(r["family"])
    return [out[k] for k, _ in rows]


def test_licences_outside_the_families_are_unknown(spark, model):
    assert len(OUTSIDE) >= 20
    assert dict(zip(OUTSIDE, found(spark, model, OUTSIDE))) == {t: set() for t in OUTSIDE}
    inside = [t for ts in licences.OTHERS.values() for t in ts]
    assert dict(zip(inside, found(spark, model, inside))) == {t: set() for t in inside}


def test_lines_and_titles_of_the_families(spark, model):
    assert dict(zip(INSIDE, found(spark, model, INSIDE))) == {t: {f} for t, f in INSIDE.items()}


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_whole_texts_and_comments(spark, model, mark):
    texts = ["\n".join(["/* header", *(mark + line for line in t.split("\n")), "code"]) for t in WHOLE.values()]
    assert dict(zip(WHOLE, found(spark, model, texts))) == {f: {f} for f in WHOLE}


def test_natively_as_in_plain_form(spark, model):
    texts = OUTSIDE + [re.sub(r"\s+", " ", t) for t in INSIDE] + [t for ts in licences.TEMPLATES.values() for t in ts]
    for text, families in zip(texts, found(spark, model, texts)):
        p = model.probabilities(text)
        best = model.families[p[:-1].argmax()] if p.argmax() < len(model.families) and p.max() >= licences.LEAST_PROBABILITY else None
        assert best is None or not licences.is_like(text, best) or best in families, text


def test_passages_far_from_the_beginning(spark):
    """The text of a passage is all of it, wherever in a long line it is, also after letters that lower case makes others."""
    model = licences.fit(["some plain words of a text", "and other words, by the same"])
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    before = "Kelvin İstanbul AİBİ café " * 400
    rows = [(1, f"{before}{mit}. And so on"), (2, f"{before}\n{before}{mit[:80]}\n * {mit[80:]}; {before}")]
    got = {r["doc_id"]: r for r in licences.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {i: (r["family"], r["paragraph"]) for i, r in got.items()} == {1: ("MIT", 0), 2: ("MIT", 1)}
    assert mit in got[1]["paragraph_text"] and f"{mit[:80]}\n * {mit[80:]}" in got[2]["paragraph_text"]
    assert len(got[2]["paragraph_text"]) < 400 and all(abs(r["probability"] - model.probabilities(r["paragraph_text"]).max()) < 1e-9 for r in got.values())


def test_long_lines_are_learned_from_wherever(spark, monkeypatch):
    """Samples of long lines come from all of them, not from their beginnings; all words of a sample count."""
    seen = {}
    monkeypatch.setattr(licences, "fit", lambda negatives: seen.setdefault("negatives", negatives))
    texts = [" ".join(f"w{i}x{k}" for k in range(2000)) for i in range(40)]
    licences.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    monkeypatch.undo()
    at = [texts[int(re.search(r"w(\d+)x", t)[1])].index(t) for t in seen["negatives"]]
    assert len(at) == 40 and len(set(at)) >= 4 and max(at) > 8000 and all(len(t) <= licences.PIECE for t in seen["negatives"])
    long = " ".join(f"v{k}" for k in range(300))
    assert long.split() in licences._examples([long], licences.np.random.default_rng(0))[0]
