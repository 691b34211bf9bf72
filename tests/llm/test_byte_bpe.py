import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tilewise.llm import byte_bpe

PATH = byte_bpe.vocabulary()
SIGNS = ["ab cde  \n\t'slvermdt", "aaaa b", "  '' .,!?-=_*#", "the quick'sll 123 456 é　中文字日本語", "한글😀👍🏽è\x85\x1c�\U0001fae8՘߽\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(PATH, byte_bpe.lookahead_of(PATH))


def same(codec, library, text, block):
    ids = np.frombuffer(b"".join(codec.encode(text, block)), "<u4")
    want = library.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert "".join(codec.decode(ids[k : k + 3] for k in range(0, len(ids), 3))) == library.decode(want, skip_special_tokens=False) == text


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60), st.integers(1, 70))
def test_any_text_in_any_blocks(codec, library, text, block):
    same(codec, library, text, block)


@pytest.mark.parametrize("seed", range(4))
def test_odd_texts(codec, library, seed, monkeypatch):
    """Long runs, contractions and special tokens over block ends; also with pieces that are open early and settled often."""
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(byte_bpe, "OPEN", 8)
        monkeypatch.setattr(byte_bpe, "SETTLE", 4)
    for _ in range(500):
        signs, n = rng.choice(SIGNS), rng.choice([0, 1, 2, 5, 20, 100])
        parts = (rng.choice(signs) * rng.choice([1, 1, 1, 5, 40]) if rng.random() < 0.8 else rng.choice(["<|endoftext|>", "<|endof", "'re", "'ll", " "]) for _ in range(n))
        same(codec, library, "".join(parts), rng.choice([1, 2, 3, 7, 50]))


@pytest.mark.parametrize("text", ["a" * 60_000, " " * 30_001, "abcdefgh" * 5000, "=" * 30_000 + "-" * 20_000, "\n" * 9999 + "x", "ÃÂ" * 10_000, "日本" * 10_000, " " + "0123456789" * 3000])
def test_pieces_without_end_in_constant_memory(codec, library, text, monkeypatch):
    most, settle = [0], byte_bpe.Transducer._settle

    def watched(self):
        out = settle(self)
        most[0] = max(most[0], len(self.last))
        return out

    monkeypatch.setattr(byte_bpe.Transducer, "_settle", watched)
    same(codec, library, text, 5000)
    assert 0 < most[0] <= codec.lookahead + codec.merges.longest + 1


def write_vocabulary(folder, rules):
    """A vocabulary file of ASCII merges."""
    signs = byte_bpe.byte_signs()
    tokens = [*signs, *(a + b for a, b in rules)]
    given = {"version": "1.0", "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}
    given["model"] = {"type": "BPE", "vocab": {t: k for k, t in enumerate(tokens)}, "merges": [list(r) for r in rules]}
    (folder / "v.json").write_text(json.dumps(given))
    return str(folder / "v.json")


@pytest.mark.parametrize("seed", range(6))
def test_the_lookahead_suffices_for_random_merge_lists(seed, tmp_path):
    """Of two texts with one beginning, tokens that end the lookahead before its end are alike; and encodings equal the library's."""
    rng = random.Random(seed)
    known, rules = list("ab"), []
    while len(rules) < 12:
        a, b = rng.choice(known), rng.choice(known)
        if a + b not in known and len(a + b) < 9:
            known.append(a + b)
            rules.append((a, b))
    path = write_vocabulary(tmp_path, rules)
    codec, library = byte_bpe.Codec(path), Tokenizer.from_file(path)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    for _ in range(60):
        head = word(codec.lookahead + rng.randrange(40))
        ends = []
        for text in (head + word(rng.randrange(30)) for _ in range(4)):
            same(codec, library, text, 7)
            at, own = 0, []
            for t in library.encode(text, add_special_tokens=False).tokens:
                at += len(t)
                own.append(at)
            ends.append([p for p in own if p <= len(head) - codec.lookahead])
        assert all(e == ends[0] for e in ends)


def test_improper_merge_lists_are_refused(tmp_path):
    with pytest.raises(ValueError, match="proper"):
        byte_bpe.Merges(write_vocabulary(tmp_path, [("ab", "c"), ("a", "b")]))
    with pytest.raises(ValueError, match="proper"):
        byte_bpe.Merges(write_vocabulary(tmp_path, [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]))


def test_broken_bytes_and_unknown_ids(codec, library):
    ids = library.encode("日é😀", add_special_tokens=False).ids
    for cut in ([ids[0], ids[-1]], ids[1:], ids[:-1], ids[::-1], [ids[-1]] * 3):
        assert "".join(codec.decode([np.array([i], np.uint32) for i in cut])) == library.decode(cut, skip_special_tokens=False)
    assert "".join(codec.decode([np.array([4_000_000_000, 64], np.uint32)])) == library.decode([64])


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents(spark, docs, odd, none, library):
    for df in (docs, odd.withColumn("ids", odd["kind"]).withColumn("n_tokens", odd["doc_id"])):
        want = sorted((r["doc_id"] or 0, *digest(library, r["text"])) for r in df.select("doc_id", "text").collect())
        assert sorted((r[0] or 0, *r[1:]) for r in byte_bpe.round_trip(df).collect()) == want
    assert byte_bpe.round_trip(none).collect() == byte_bpe.encode(none).collect() == []
    back = byte_bpe.decode(byte_bpe.encode(odd))
    assert sorted(map(str, back.collect())) == sorted(map(str, odd.selectExpr("doc_id", "coalesce(text, '') AS text").collect()))
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]
