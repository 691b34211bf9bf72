import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tilewise.llm import spelling

SMALL = str.maketrans({c: chr(ord(c) + 32) for c in spelling.UPPER})


def counted(rows, divisor=199, least=6):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % divisor == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def one_edit(a, b):
    """By comparison, not by generation."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[head + (len(a) >= len(b)) :] == b[head + (len(b) >= len(a)) :]


def grouped(words, ratio=5):
    out, form = {}, {}
    for w, n in words.items():
        near = sorted((-words[x], x) for x in words if one_edit(w, x))
        form[w] = near[0][1] if near and -near[0][0] >= ratio * n else None
        out[w] = [form[w], w, n, len(near), words[form[w]] if form[w] else None]
    for w, row in out.items():
        while form[row[1]]:
            row[1] = form[row[1]]
    return out


def rows_of(df):
    return {r["word"]: [r["form"], r["root"], r["n"], r["n_near"], r["form_n"]] for r in df.collect()}


def test_documents_against_comparison(spark, docs):
    found = rows_of(spelling.variants(docs))
    words = {w: n for w, n in counted([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]).items() if n >= 5}
    assert found == grouped(words) and any(r[0] for r in found.values())


def test_chains_ties_and_letters(spark):
    n = {"kitten": 625, "kittens": 125, "mittens": 25, "mittensé": 5, "sitten": 625, "éclair": 30, "Éclair": 6, "aaabbb": 40, "aabbb": 9, "aaaabbb": 8, "aaabbbb": 7, "zzzzzz": 5}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows_of(spelling.group(df))
    assert got == grouped(n)
    assert got["mittensé"][:2] == ["mittens", "kitten"] and got["kittens"][0] == "kitten" and got["sitten"][3] == 1


@pytest.mark.parametrize("bits", [1 << 16, 1 << 4])
def test_every_string_once_and_none_lost(spark, bits, monkeypatch):
    """A bit map too small for the vocabulary only lets more candidates through."""
    monkeypatch.setattr(spelling, "LEAST_BITS", 1 << 4)
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abc"), rng.integers(6, 9))): int(n) for n in rng.integers(5, 999, 400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.candidates(df, list("abc"), bits)
    assert found.groupBy("word", "candidate").count().where("count > 1").count() == 0
    assert rows_of(spelling.group(df, most_bits=bits)) == grouped(words)


def test_neighbourhood_hashes():
    import pyarrow as pa

    word, letters = "aabca", np.array([ord(c) for c in "abcz"], np.uint32)
    codes = np.array([[ord(c) for c in word]], np.uint32)
    got = []
    for kind, i, h, counts in spelling.neighbourhood(codes, letters):
        for c in np.flatnonzero(counts[0]):
            (text,) = spelling._strings(spelling._edited(codes, kind, i, letters[[c]]))
            assert spelling.hashes(pa.array([text]))[0] == h[0, c]
            got.append(text)
    want = {word[:i] + word[i + 1 :] for i in range(5)} | {word[:i] + c + word[i + 1 :] for i in range(5) for c in "abcz"} | {word[:i] + c + word[i:] for i in range(6) for c in "abcz"}
    assert len(got) == len(set(got)) and set(got) == want - {word}


def test_odd_rows(spark, odd, none):
    assert rows_of(spelling.variants(none)) == rows_of(spelling.variants(odd)) == {}
    rows = [(k, "Spelling sPELLING À×÷ÿßþ spellinG spellings2spellings") for k in (3, 3, None, 400)] + [(5, None), (6, ""), (7, "spell1ng " * 50)]
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], "doc_id long, text string, word string, n int")
    for divisor in (199, 1, 2):
        words = {w: n for w, n in counted(rows, divisor).items() if n >= 2}
        assert rows_of(spelling.variants(df, most_rare=2, divisor=divisor)) == grouped(words)


def test_circles_are_refused(spark):
    with pytest.raises(RuntimeError, match="circles"):
        spelling.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "word string, form string"), most_rounds=3)
