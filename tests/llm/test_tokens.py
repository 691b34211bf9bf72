import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilewise.llm import packing, storage, token_counts, token_files, tokens

LIBRARY = Tokenizer.from_file(tokens.tokenizer_path())


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aBé ,.'\n<|>endoftx1\x1c\x01ÀßİΣ", max_size=60)), max_size=8))
def test_ids_are_the_librarys(texts):
    assert [x.tolist() for x in tokens.encode_lists(texts)] == [ids(t) for t in texts]


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 5)
    own = tokens.WordEncoder(tokens.tokenizer_path())
    for text in ("a b c d", "e f g h, i.", "a b c d e f g h i j k l"):
        flat, sizes = own.encode(pa.array([text]))
        assert flat.tolist() == ids(text) and sizes.tolist() == [len(flat)]


def check_packing(rows, texts, capacity):
    by_doc = {}
    for r in rows:
        want = np.array((texts[r["doc_id"]] + [1])[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["start"] == r["piece"] * capacity and len(want) == r["length"] and zlib.crc32(want) == r["ids_crc32"]
        by_doc.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_doc.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_doc)


def test_packing_whole_documents(docs):
    rows, texts = packing.pack(docs, capacity=512).collect(), {r["doc_id"]: ids(r["text"]) for r in docs.collect()}
    n = check_packing(rows, texts, 512)
    total = sum(len(t) + 1 for t in texts.values())
    assert sum(r["length"] for r in rows) == total and n <= 1.02 * total / 512 + 1


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 5, 7: 2, 8: 1, None: 1}
    assert packing.pack(none).count() == 0
    whole = packing.sequences(odd.where("doc_id IS NOT NULL"), capacity=4096).collect()
    assert all(len(r["ids"]) <= 4096 for r in whole) and sum(len(r["ids"]) for r in whole) == 20_001 + sum(len(ids(r["text"])) + 1 for r in odd.where("doc_id <> 6").collect())


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=30))
def test_plans_place_each_piece_once(histogram):
    plan = packing.make_plan(histogram, capacity=64, classes=16)
    slots = {}
    for n, rank, count, seq, offset in zip(*(plan[k] for k in ("length", "rank", "count", "sequence", "offset"))):
        assert rank == sum(c for _, c, *_ in slots.get(n, []))
        slots.setdefault(n, []).append((rank, count, seq, offset))
    assert {n: sum(c for _, c, *_ in v) for n, v in slots.items()} == histogram
    used = Counter()
    for n, v in slots.items():
        for _, count, seq, _ in v:
            used.update({s: int(n) for s in range(seq, seq + count)})
    total = sum(n * c for n, c in histogram.items())
    assert all(x <= 64 for x in used.values()) and len(used) == plan["sequences"] <= 2 * total / 64 + 1


def test_least_squares():
    rng = np.random.default_rng(5)
    a = rng.random((12, 7))
    x = np.maximum(rng.normal(size=7), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=12)
    got = packing.nnls(a, b)
    slope = a.T @ (b - a @ got)
    assert (got >= 0).all() and (slope <= 1e-6).all() and np.allclose(slope[got > 0], 0, atol=1e-6)


def test_token_files(spark, docs):
    folder = storage.new_path(spark, "files")
    shards = token_files.write(docs, folder, shards=3)
    got = {r["doc_id"]: r for r in token_files.read(shards, keep_ids=True).collect()}
    at = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        want = ids(r["text"]) + [2]
        g = got[r["doc_id"]]
        assert g["ids"] == want and g["start"] == at and g["n_tokens"] == len(want) and g["ids_crc32"] == zlib.crc32(np.array(want, "<u4"))
        at += len(want)
    one = shards.orderBy("shard").first()
    shard = token_files.Shard(one["file"])
    first = int(shard.index[5, 0])
    assert [x.tolist() for x in shard.find(first)] == [got[first]["ids"]] and shard.find(10**9) == []
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(one["file"], b"other")


def test_token_files_odd_rows(odd, none):
    rows = token_files.round_trip(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1, None: 1}
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[6] == 20_001 and {r["doc_id"]: r["n_tokens"] for r in rows}[1] == 1
    assert token_files.round_trip(none).count() == 0


def test_token_files_of_a_hot_doc_id(spark, monkeypatch):
    monkeypatch.setattr(token_files, "READ_BYTES", 64)
    rows = [(i, f"text number {i}") for i in range(200)] + [(77, "a copy")] * 150
    shards = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), storage.new_path(spark, "files"), shards=8)
    sizes = [r["n_docs"] for r in shards.collect()]
    assert sum(sizes) == 350 and max(sizes) < 80
    got = sorted(token_files.read(shards, keep_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((i, ids(t) + [2]) for i, t in rows)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(350)]


@pytest.mark.parametrize("block", [4, 1000, 1 << 20])
def test_separator_scan(odd, none, block):
    if block == 4:
        odd = odd.where("doc_id <> 6")
    rows = token_counts.document_counts(odd, block_bytes=block).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["terminated"]) for r in rows) == Counter((r["doc_id"], len(ids(r["text"])), True) for r in odd.collect())
    assert token_counts.document_counts(none).count() == 0


def test_special_tokens_in_texts(spark):
    texts = ["one", "two <|endoftext|> three", "<|endoftext|>", "four five six", "<|startoftext|> seven", None, "eight"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert 49407 in ids(texts[1])
    rows = token_counts.document_counts(frame).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["terminated"]) for r in rows) == [(i, len(ids(t)), True) for i, t in enumerate(texts)]
    with pytest.raises(Exception, match="end-of-document id 49407"):
        token_counts.document_counts(frame, end_id=49407)


@settings(deadline=None, max_examples=8)
@given(st.lists(st.integers(0, 3), max_size=40), st.sampled_from([2, 6, 64]))
def test_scan_of_any_file(spark, numbers, block):
    folder = storage.new_path(spark, "flat").removeprefix("file://")
    import os

    os.makedirs(folder)
    np.array(numbers, "<u2").tofile(f"{folder}/f")
    want, at = [], 0
    for k, x in enumerate(numbers):
        if x == 3:
            want.append((at, k - at, True))
            at = k + 1
    if at < len(numbers):
        want.append((at, len(numbers) - at, False))
    files = spark.createDataFrame([(f"file://{folder}/f", 2 * len(numbers))], "file string, bytes long")
    got = token_counts.scan(files, end_id=3, block_bytes=block).orderBy("number").collect()
    assert [(r["start"], r["n_tokens"], r["terminated"]) for r in got] == want and [r["number"] for r in got] == list(range(len(want)))
