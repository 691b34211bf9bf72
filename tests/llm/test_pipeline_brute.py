"""The whole pipeline against plain forms of its stages, over all of a small table."""

import re
import zlib
from functools import cache

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tilewise.llm import decontaminate, language, pii, tokens

from test_texts import SF, brute_components, edits


def in_a_language(rows, model):
    """Documents whose letters' runs, each as the sum over all of its segmentations, say a language with enough probability."""
    number = {p: i for i, p in enumerate(model.pieces)}

    @cache
    def word(w):
        w = language._START + w
        a = [np.ones(len(model.languages))]
        for e in range(1, len(w) + 1):
            sums = np.zeros(len(model.languages))
            for s in range(e):
                if w[s:e] in number:
                    sums += a[s] * model.p[number[w[s:e]]]
                elif e - s == 1:
                    sums += a[s] * model.p[-1]
            a.append(sums)
        return np.log(a[-1])

    kept = []
    for i, text in rows:
        runs = re.findall(r"[^\W\d_]+", re.sub("[½¼¾²³¹]", " ", (text or "").lower()))
        if runs:
            logs = sum(map(word, runs))
            p = np.exp(logs - logs.max())
            if (p / p.sum()).max() >= language.LEAST_SCORE:
                kept.append((i, text))
    return kept


def holds_a_passage(text, items):
    """Whether some window of an item is in the text within its edits, by alignment of the windows that share a part with it exactly."""
    plain = "".join(map(chr, decontaminate.signs(text)))
    for item in items:
        index = decontaminate.Index([(0, item)])
        w, k = int(index.window[0]), int(index.edits[0])
        p = "".join(map(chr, decontaminate.signs(item)))
        part = w // (k + 1)  # of k + 1 parts of a window one has no edit
        shared = {i for i in range(len(p) - part + 1) if p[i : i + part] in plain}
        for i in range(len(p) - w + 1):
            if any(i <= s <= i + w - part for s in shared) and edits(p[i : i + w], plain) <= k:
                return True
    return False


def test_pipeline_against_plain_stages(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    kept = in_a_language(rows, language.train(docs))
    parts = brute_components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if parts[i][1] == i]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r["text"] and len(r["text"]) > decontaminate.Q]
    clean = [(i, t) for i, t in kept if not holds_a_passage(t, items)]
    assert 0 < len(clean) < len(kept) < len(rows)
    masked = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(clean, "doc_id long, text string")).collect()}
    library = Tokenizer.from_file(tokens.tokenizer_path())
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in masked.items()}

    got = corpus_pipeline.run(spark, SF).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            own = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(own.tobytes())) and r["length"] == min(4096, len(ids) - at)
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.05 * -(-sum(map(len, want.values())) // 4096) + 1
