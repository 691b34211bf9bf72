import itertools
import random
import re
import textwrap

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewise.llm.words import Words
from tilewise.llm import components, decontaminate, language, licences, neighbours, pii, pii_sql, sharding, shingle_join, storage

SF = "/root/testdata/sf0.001"


def test_forward_sums_all_segmentations():
    pieces = language.Pieces([language._START, "a", "b", "ab", language._START + "a", "ba", "aba"])
    p = np.random.default_rng(0).random((8, 2))

    def brute(s):
        if not s:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(s) + 1):
            if s[:n] in pieces.pieces:
                out = out + p[pieces.pieces.index(s[:n])] * brute(s[n:])
            elif n == 1:
                out = out + p[-1] * brute(s[1:])
        return out

    words = ["aba", "b", "abab", "xab", "a", "bbaabax"]
    assert np.allclose(np.exp(language.forward(pieces.arcs(words), p)[0]), [brute(language._START + w) for w in words])
    one, counts = p[:, :1] / p[:, :1].sum(), np.array([2.0, 1, 3, 1, 1, 4])
    uses = language.expected(pieces.arcs(words), one, counts)
    signs = sum(c * len(language._START + w) for w, c in zip(words, counts))
    lengths = np.array([len(x) for x in pieces.pieces] + [1])
    assert np.isclose((uses * lengths).sum(), signs)


def test_languages_of_held_out_documents(docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 200 and len(held) > 40 and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_languages_of_odd_rows(spark, docs, odd, none):
    model = language.train(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()]
    assert len(got) == 10 and {(i, p, s) for i, p, s in got if i in (1, 2, 5, 8)} == {(i, "und", 0.0) for i in (1, 2, 5, 8)}
    assert all(p in model.languages for i, p, s in got if i in (3, 4, 6, 7))
    assert language.predict(none, model).count() == 0 and language.identify(none.select("doc_id", "text", "lang")).count() == 0
    bare = language.predict(odd, language.train(none)).collect()
    assert {r["lang_pred"] for r in bare} == {"und"}


def test_language_of_few_long_texts(spark):
    """Each language gives about the sample, whether its text lies in many documents or in one."""
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(1, " ".join(word("abcdef") for _ in range(60_000)), "one")]
    rows += [(i, " ".join(word("tuvwxy") for _ in range(60)), "many") for i in range(2, 1002)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame, sample_chars=40_000)
    asked = spark.createDataFrame([(1, "abba feed"), (2, "tutu wxyt")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.predict(asked, model).orderBy("doc_id").collect()] == ["one", "many"]
    assert (model.p.max(axis=0) > 2 * model.p.min(axis=0)).all()  # neither is the uniform distribution


def test_number_signs_are_no_letters(spark, docs):
    texts = ["½ ² Ⅷ", "①②", "٣٤٥ 123", "½ the house and the garden", "日本"]
    frame = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string, score double")
    got = language.predict(frame, language.train(docs), names=("lang_pred", "own")).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["own"] for r in got[:3]] == [0.0] * 3
    assert got[3]["lang_pred"] != "und" and got[4]["lang_pred"] != "und" and got[0]["a.b"] == "en" and got[0]["score"] == 0.5


def test_predictions_against_brute_force(spark):
    """A small model: pieces' probabilities summed over all segmentations of each run of letters."""
    model = language.fit({"de": {"das": 5, "haus": 3, "und": 4}, "en": {"the": 6, "house": 3, "and": 4}, "xx": {"zzz": 1}})
    number = {p: i for i, p in enumerate(model.pieces)}

    def word(w):
        a = [np.ones(len(model.languages))]
        w = language._START + w
        for e in range(1, len(w) + 1):
            sums = np.zeros(len(model.languages))
            for s in range(e):
                if w[s:e] in number:
                    sums += a[s] * model.p[number[w[s:e]]]
                elif e - s == 1:
                    sums += a[s] * model.p[-1]
            a.append(sums)
        return np.log(a[-1])

    texts = ["das Haus", "the HOUSE, and the-and", "und and", "ж ½ x", "zzz! das", "a1b2c3 ǆ", "", None, "12 ½", "the"]
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        runs = re.findall(r"[^\W\d_]+", re.sub("[½]", " ", (t or "").lower()))
        if not runs:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logs = sum(map(word, runs))
        p = np.exp(logs - logs.max())
        assert r["lang_pred"] == model.languages[p.argmax()] and abs(r["score"] - p.max() / p.sum()) < 1e-4


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_shingle_join_against_brute_force(spark, docs, k, percent):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 4, 9, 12, 25, 60])))) for i in range(60)]
    for i in range(60, 220):  # near copies with a few changes, and copies of those
        own = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    rows += [(300, None), (301, ""), (302, "  "), (303, "Word  two\tTHREE four five six")]
    got = shingle_join.link(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, percent)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, percent = int(rng.integers(1, 120)), int(rng.choice([50, 80, 90]))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        gone = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)])
        if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            sigs, counts = shingle_join.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
            assert set(sigs[: counts[0]].tolist()) & set(sigs[counts[0] :].tolist())


def test_shingle_join_odd_rows(spark, odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.link(odd, 3, 90).collect()), key=str)
    assert len(got) == 10 and (7, 4, 7) in got and (1, 0, 1) in got and (5, 0, 5) in got and (6, 1, 6) in got
    assert shingle_join.link(none).count() == 0
    kept = shingle_join.deduplicate(odd)
    assert kept.count() == 10 and kept.columns == odd.columns


def test_near_copies_just_under_the_threshold(spark):
    """One large group of near copies of one text, most of them not similar to each other, and a few that are."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(260):
        own = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 4, 4, 5, 5])):
            own[at] = f"x{i}_{at}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows + [(1000 + i, rows[i % 3][1]) for i in range(50)], "doc_id long, text string")
    got = shingle_join.link(frame, 3, 90).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components([tuple(r) for r in frame.collect()], 3, 90)
    assert 5 < len({r["component_id"] for r in got}) < 260


def test_large_buckets_are_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    rng = random.Random(12)
    rows = [(i, " ".join("z" if rng.random() < 0.12 else f"w{k}" for k in range(40))) for i in range(80)]
    got = shingle_join.link(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 1, 80)


def test_words_as_hashes():
    rng, signs = random.Random(1), "aAbZ \t\n\x0b\x0c\r\x1c\x85\u3000éÉ"
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(signs, k=rng.choice([0, 1, 3, 10, 30]))) for _ in range(20)]
        own = Words(pa.array(["zz", *texts])[1:], lower=True, keys=2)
        want = [words_of(t) for t in texts]
        assert own.counts.tolist() == [len(w) for w in want]
        flat, keys = [w for ws in want for w in ws], list(zip(*(k.tolist() for k in own.keys)))
        assert len(set(zip(flat, keys))) == len(set(flat)) == len(set(keys))
        plain = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        assert own.strings(np.arange(len(plain))) == plain


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(50)}


def edits(p, t):
    c = np.zeros(len(t) + 1, int)
    for sign in p:
        n = np.empty_like(c)
        n[0] = c[0] + 1
        n[1:] = np.minimum(c[:-1] + (np.array(list(t)) != sign), c[1:] + 1)
        c = np.minimum.accumulate(n - np.arange(len(n))) + np.arange(len(n))
    return c.min()


def whole_edits(p, t):
    c = list(range(len(t) + 1))
    for i, sign in enumerate(p, 1):
        n = [i]
        for j, other in enumerate(t, 1):
            n.append(min(c[j - 1] + (other != sign), c[j] + 1, n[-1] + 1))
        c = n
    return c[-1]


def test_short_items_and_white_space(spark):
    items = spark.createDataFrame([(1, "Yes, 42"), (2, "one of the longer items\u3000of this benchmark"), (3, ""), (4, None)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "he said YES, 42 times"), (2, "yes, 421"), (3, "x one of the longer\titems of\u2003this benchmark x"), (4, None)], "doc_id long, text string")
    got = [tuple(r) for r in decontaminate.leaks(texts, items).orderBy("doc_id").collect()]
    assert got[0] == (1, 1, 0, 8, 15) and [(r[0], r[1], r[2]) for r in got] == [(1, 1, 0), (3, 2, 0)]
    assert {r["doc_id"] for r in decontaminate.clean(texts, items).collect()} == {1, 2, 4}


def test_passages_against_brute_force():
    rng = random.Random(3)
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    found = 0
    for _ in range(60):
        item = rng.choice(items)
        n = rng.choice([len(item), len(item), 110, 90, 60])
        at = rng.randrange(max(1, len(item) - n + 1))
        part = list(item[at : at + n])
        for _ in range(rng.choice([0, 2, 4, 6, 8, 10, 12])):
            part[rng.randrange(len(part))] = rng.choice(["", "x", "yz"])
        text = rng.choice(texts)[:200] + "".join(part) + rng.choice(texts)[50:200]
        index = decontaminate.Index([(7, item)])
        p, t = ("".join(map(chr, decontaminate.signs(x))) for x in (item, text))
        w, k = int(index.window[0]), int(index.edits[0])
        want = any(edits(p[i : i + w], t) <= k for i in range(len(p) - w + 1))
        got = index.find(["other", text, None, ""])
        assert bool(got) == want
        for _, _, n, a, b in got:  # some window of the item is the span, with just so many edits
            own = t[a:b]
            fewest = min(whole_edits(p[i : i + w], own) for i in range(len(p) - w + 1))
            assert fewest <= n <= k
        found += want
    assert 10 < found < 50


def test_decontamination_in_blocks(spark, docs, odd, none):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    many = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark, block_chars=4000).collect()}
    items, texts = benchmark.collect(), docs.collect()
    exact = {(d["doc_id"], b["item_id"]) for d in texts for b in items if b["text"] in d["text"]}
    assert one == many and exact <= one and exact
    kept = decontaminate.clean(odd, benchmark)
    assert kept.count() == 10 and kept.columns == odd.columns
    assert decontaminate.leaks(none, benchmark).count() == 0 and decontaminate.leaks(docs, none.selectExpr("doc_id AS item_id", "text")).count() == 0


PII_ROWS = [
    (1, None), (2, ""), (3, "a@b.co_x@y.com a@b a.b+c@d-e.f.g. x@y@z.w"), (4, "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3 12.34.56.78.9"),
    (5, "4111 1111 1111 1111x 4111-1111-1111-1112 5500005555555559x 1-2-3"), (6, "+1 (555) 123-4567 +12345 +1.(-) 2 ++44 20 7946 0958-"),
    (7, "my iban is DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE89370400440532013001"), (8, "ssn 123-45-6789 and 123-45-6789 alone"),
    (9, "é@b.co ü+a@b.co é4111111111111111é 😀+1 555 123 4567"), (10, "x" * 20000 + "@" + "y" * 100 + ".z"), (11, "1" * 3000), (12, "+1 555 123 4567; a@b.cc " * 600),
]


def test_personal_data_equals_its_sql(spark, docs):
    for frame in (spark.createDataFrame(PII_ROWS, "doc_id long, text string"), docs):
        con = duckdb.connect()
        con.register("documents", frame.toPandas())
        want = con.sql(pii_sql.sql()).df().sort_values("doc_id").reset_index(drop=True)
        got = pii.digest(pii.with_spans(frame)).toPandas().sort_values("doc_id").reset_index(drop=True)
        for c in got.columns:
            assert (got[c].fillna(-1) == want[c].fillna(-1)).all(), c


def test_redaction(spark, odd, none):
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(PII_ROWS, "doc_id long, text string")).collect()}
    assert got[1] is None and got[2] == "" and got[8] == "ssn [SSN] and [SSN] alone"
    assert got[7] == "my iban is [IBAN] and [IBAN], DE89370400440532013001" and got[5].startswith("[CARD]x ") and "é[CARD]é 😀[PHONE]" in got[9]
    same = pii.redact(odd)
    assert same.columns == odd.columns and same.exceptAll(odd).count() == 0 and pii.redact(none).count() == 0
    clash = odd.withColumn("pii", odd.kind)
    assert pii.with_spans(clash).count() == 10


def test_licences(spark, odd, none):
    model = licences.fit(["some plain words of a text", "and other words, by the same"])
    for family, templates in licences.TEMPLATES.items():
        for t in templates:
            p = model.probabilities(t)
            assert model.families[p[:-1].argmax()] == family and p[:-1].max() >= licences.LEAST_PROBABILITY
    assert all(model.probabilities(t).argmax() == len(model.families) for t in licences.NOT_LICENCES + ["", "hello there"])
    rows = [(1, "first\nReleased under the MIT License.\nlast"), (2, "You need a driver's license."), (3, "Licensed under the Apache License, Version 2.0."), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = licences.find(frame, model).collect()
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in sorted(got)] == [(1, 1, "MIT"), (3, 0, "Apache-2.0")]
    assert all(abs(r["probability"] - model.probabilities(r["paragraph_text"]).max()) < 1e-9 and r["likeness"] == 1 for r in got)
    assert licences.find(odd, model).count() == 0 and licences.find(none, model).count() == 0


def test_licences_against_a_plain_form(docs):
    model = licences.train(docs)
    want = set()
    for r in docs.collect():
        for k, line in enumerate((r["text"] or "").split("\n")):
            p = model.probabilities(line)
            if p.argmax() < len(model.families) and p.max() >= licences.LEAST_PROBABILITY:
                pairs = lambda t: {tuple(w) for w in zip(licences.words(t), licences.words(t)[1:])}
                if any(len(pairs(line) & pairs(t)) >= licences.LEAST_LIKENESS * len(pairs(t)) for t in licences.TEMPLATES[model.families[p.argmax()]]):
                    want.add((r["doc_id"], k, model.families[p.argmax()]))
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.find(docs, model).collect()} == want


@pytest.mark.parametrize("family,at", [("MIT", 2), ("Unlicense", 1)])
def test_licences_that_the_sample_holds(spark, family, at):
    notice = licences.TEMPLATES[family][at]
    frame = spark.createDataFrame([(i, notice if i % 2 else f"some plain words of text {i}") for i in range(60)], "doc_id long, text string")
    got = licences.find(frame).collect()
    assert sorted((r["doc_id"], r["family"]) for r in got) == [(i, family) for i in range(1, 60, 2)]


def test_licences_over_and_within_lines(spark):
    model = licences.fit(["some plain words of a text", "and other words, by the same"])
    long = [(k, t) for k, ts in licences.TEMPLATES.items() for t in ts if len(t) > 100]
    rows, want = [], []
    for family, t in long:
        for width in (76, 40):
            lines = textwrap.wrap(t, width)
            want.append((len(rows), 2 if (family, width) == ("LGPL", 76) else 1, family))  # its second line is a notice by itself
            rows.append((len(rows), "\n".join(["# a header", *("# " + x for x in lines), "#", "code = 1"])))
    want += [(100, 0, "Apache-2.0"), (100, 0, "BSD"), (100, 0, "MIT"), (101, 0, "CC-BY"), (101, 0, "MIT")]
    rows.append((100, " ".join(["filler words"] * 50 + [licences.TEMPLATES["MIT"][2], "and so on", licences.TEMPLATES["BSD"][0], "more"] + ["filler words"] * 50 + [licences.TEMPLATES["Apache-2.0"][1]])))
    rows.append((101, "Released under the MIT License. This work is licensed under a Creative Commons Attribution 4.0 International License."))
    got = licences.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in got) == want


def test_every_likely_text_holds_a_seed():
    model, rng = licences.fit(["some plain words"]), random.Random(6)
    pattern = re.compile(licences._any_pair(model.seeds))
    for t in itertools.chain(*licences.TEMPLATES.values()):
        own = licences.words(t)
        for _ in range(200):
            text = " -\n ".join(w for w in own if rng.random() > 0.25)
            if len(licences.pairs(licences.words(text)) & licences.pairs(own)) >= licences.LEAST_LIKENESS * len(licences.pairs(own)):
                assert pattern.search(text)


def test_shards(spark, docs, odd, none):
    for frame, limit in ((docs, 20_000), (odd, 500)):
        con = duckdb.connect()
        got = sharding.assign(frame, limit).toPandas()
        assert len(got) == frame.count()
        size = got.assign(b=[len((t or "").encode()) for t in got.text]).groupby("shard").b.agg(["sum", "size"])
        assert ((size["sum"] <= limit) | (size["size"] == 1)).all()
        if frame is docs:
            con.register("documents", frame.toPandas())
            want = con.sql(sharding.sql(limit)).df()
            assert dict(zip(got.doc_id, got.shard)) == dict(zip(want.doc_id, want.shard)) and len(size) > 20
    same = sharding.assign(spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string"), 1000).groupBy("shard").count().collect()
    assert [r["count"] for r in same] == [10] * 5 and sharding.assign(none).count() == 0


def test_shards_of_hot_cells(spark, docs, monkeypatch):
    alike = spark.range(400).select(F.lit(10**9).cast("long").alias("doc_id"), F.lit("").alias("text"))
    frame = docs.select("doc_id", "text").union(alike)
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.sql(sharding.sql(20_000)).df()
    for hot in (1, 8, 1 << 30):  # no cell is hot, one is, all are
        monkeypatch.setattr(sharding, "HOT", hot)
        got = sharding.assign(frame, 20_000).select("doc_id", "shard", "shard_depth", "shard_bytes").toPandas()
        assert len(got) == frame.count() and set(map(tuple, got.to_numpy().tolist())) == set(map(tuple, want[list(got.columns)].to_numpy().tolist()))


def test_placed_rows_have_no_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 8)
    rows = spark.range(800).select(F.when(F.col("id") < 400, F.lit(3)).otherwise(F.col("id")).alias("__bits"))
    leaves = rows.groupBy(F.col("__bits").alias("cell")).agg(F.count("*").alias("n")).select("cell", "n", F.lit(60).alias("depth"), F.col("cell").alias("prefix"), F.lit(1).alias("shard_bytes"))
    placed = sharding._placed(rows, leaves, sharding.BITS, 100)
    assert placed.count() == 800 and placed.where("__prefix <> __bits").count() == 0
    assert "BroadcastHashJoin" in placed._jdf.queryExecution().toString()


def test_settled_tables_leave_only_their_result(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "new_path", lambda spark, label: f"file://{tmp_path}/{label}")
    inner = lambda: storage.written(spark.range(5), "a").union(storage.settled(lambda: storage.written(spark.range(3), "b"), "c"))
    assert storage.settled(inner, "d").count() == 8 and [x.name for x in tmp_path.iterdir()] == ["d"]
    storage.written(spark.range(2), "e")
    assert {x.name for x in tmp_path.iterdir()} == {"d", "e"}


def test_packed_signatures():
    sigs = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    for parts in (64, 7001):
        part = (sigs % np.uint64(parts)).astype(int)
        for p in np.unique(part):
            own = sigs[part == p]
            data = shingle_join._packed(own, parts)
            back = shingle_join._unpacked(np.frombuffer(data, np.uint8), int(p), parts)
            assert len(data) == 6 * len(own) and len(np.unique(back)) == len(np.unique(own)) and (back % np.uint64(parts) == p).all()


def test_shards_beside_other_columns(spark, docs):
    names = ["depth", "prefix", "a.b", "shard_bytes", "cell", "bits"]
    frame = docs.select("doc_id", "text", *(F.lit(7).alias(c) for c in names))
    got = sharding.assign(frame, 20_000)
    assert got.columns == ["doc_id", "text", *(c for c in names if c != "shard_bytes"), "shard", "shard_depth", "shard_bytes"]
    plain = sharding.assign(docs.select("doc_id", "text"), 20_000)
    assert got.select("doc_id", "shard").exceptAll(plain.select("doc_id", "shard")).count() == 0 and {r[0] for r in got.select("depth").distinct().collect()} == {7}


def test_largest_of_rows():
    rng = np.random.default_rng(2)
    for n, cells in ((1, 5), (4, 9), (7, 7), (9, 3), (64, 200)):
        about = rng.integers(0, 6, (50, cells)).astype(float)
        about[rng.random(about.shape) < 0.2] = -np.inf
        want = np.sort(np.argsort(-about, axis=1, kind="stable")[:, :n], axis=1)
        assert (neighbours.largest(about, n) == want).all()


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[700:1000] = x[700]  # many copies of one
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == set(range(0, 1500, 20))
    hit = 0
    for q, own in got.groupby("query_id"):
        own, score = own.sort_values("rank"), x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(score, 9)))[:20]
        hit += len(set(best) & set(own.vec_id))
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, [x[i] @ x[q] for i in own.vec_id])
    assert hit / len(got) >= 0.9
    beside = df.selectExpr("*", "'x' AS v", "1 AS cell", "2 AS rank", "vec_id AS query_id")  # names of the operator's own columns
    same = neighbours.search(beside, F.col("vec_id") % 20 == 0).toPandas()
    order = lambda t: t.sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert order(same).equals(order(got))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in neighbours.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 5.0), (1, 4.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_shingle_join_of_large_batches(spark):
    """70 000 texts, each twice, in one batch: more than the numbers that share 64 bits with hashes have room for."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        docs = spark.range(70_000).selectExpr("id AS doc_id", "concat_ws(' ', 'a', id % 35000, 'b', id % 35000 + 7) AS text").coalesce(1)
        got = shingle_join.link(docs, 3, 90)
        assert got.where("component_id <> doc_id % 35000 OR n_shingles <> 2").count() == 0 and got.count() == 70_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    with pytest.raises(ValueError, match="at most"):
        shingle_join.shingles(pa.array(["x"] * (shingle_join.MOST_SETS + 1)), 3)
    with pytest.raises(ValueError, match="at most"):
        shingle_join.signatures(np.zeros(0, np.uint64), np.zeros(shingle_join.MOST_SETS + 1, np.int64), 80)


def test_many_short_items():
    """Whole words of items of few signs, as a search for each item by itself finds them."""
    import re

    rng = random.Random(5)
    items = [(i, "".join(rng.choices("ab !", k=rng.randrange(1, 6)))) for i in range(60)] + [(60, "ab"), (61, "ab")]
    items = [(i, t) for i, t in items if decontaminate.signs(t).size]
    texts = ["".join(rng.choices("ab !c", k=rng.randrange(0, 60))) for _ in range(80)] + [None, ""]
    want = set()
    for k, text in enumerate(texts):
        plain = decontaminate._string(decontaminate.signs(text or ""))
        for i, t in items:
            t = decontaminate._string(decontaminate.signs(t))
            m = re.search(("(?<![a-z])" if t[0].isalnum() else "") + re.escape(t) + ("(?![a-z])" if t[-1].isalnum() else ""), plain)
            if m:
                want.add((k, i, m.start(), m.end()))
    assert set(decontaminate.Index(items).find_short(texts)) == want and len(want) > 50


def test_clean_with_short_items(spark):
    docs = spark.createDataFrame([(1, "it is 42 then"), (2, "it is 421"), (None, "42")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "42")], "item_id long, text string")
    assert decontaminate.clean(docs, items).count() == 3
    assert sorted(str(r["doc_id"]) for r in decontaminate.clean(docs, items, short=True).collect()) == ["2", "None"]


def test_neighbours_of_repeated_ids(spark):
    """Rows that share an id are queries of their own and each other's candidates."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.5]), (2, [0.5, 3.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") == 0, k=20).collect()
    want = []
    for k, (i, v) in enumerate(rows):
        if i == 0:
            near = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for m, (j, w) in enumerate(rows) if m != k)
            want += [(0, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_neighbours_whatever_the_vectors_are(spark):
    """Long vectors that a sample hardly has, near copies that codes can't tell apart, queries unlike the rows: the same lists as by brute force."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(0, 1.5, (3000, 1))
    x[1000:1800] = x[1000] + 1e-3 * rng.normal(size=(800, 24))
    x[1800:2000] = x[1800]
    x[::40] = 3 - x[::40]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    x, want = x.astype(float), {}
    for q in range(0, 3000, 20):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        want[q] = np.lexsort((np.arange(3000), -score))[:20].tolist()
    assert {q: own.vec_id.tolist() for q, own in got.groupby("query_id")} == want
