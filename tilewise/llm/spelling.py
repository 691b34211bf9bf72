"""Groups of spelling variants by full neighbourhood generation (operator 11).

Words are counted natively: runs of letters are exploded, hashed and aggregated in parts. Then each
word of the vocabulary emits every string that is one deletion, replacement or insertion away, over
the alphabet that the vocabulary itself uses, each once: a letter is deleted from the end of a run
of equal ones only, and inserted at the end of such a run only. What is emitted and is a word, is
near, so candidates are joined to the vocabulary by the string itself and nothing needs checking.

Nearly all emitted strings are no words. Their polynomial hashes follow from the word's prefix and
suffix hashes, so a task makes a word's whole neighbourhood as numbers in arrays, looks each up in
a bit map of the vocabulary's hashes (two bits a word; `MOST_BITS` at most, which bounds what the
driver and each worker hold), and only makes strings of, and shuffles, those whose bits are set. The
bit map only spares the shuffle rows: of a vocabulary too large for it more candidates travel, and the
join decides as before.

A word's form is its near word of largest count; counts grow by `ratio` from form to form, so chains
are short, and roots are found by doubling: each round follows a word's root to that one's root.

Defined cases: null or empty text has no words; a null doc_id counts as an empty one in the hash;
repeated rows count again; equal counts go to the smaller word in code-point order; an empty table, or
one without words, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import mix, release

LETTERS = "A-Za-zÀ-ÿ"
UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: A vocabulary's bit map has this many bits a word, in powers of two, and `MOST_BITS` at most (32 MB).
BITS_A_WORD, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28
#: Bits of the bit map that one row holds.
BLOCK_BITS = 1 << 20
#: Candidates that a task holds at a time, about; words that one task takes.
CANDIDATES, WORDS = 1 << 18, 20_000
#: Seeds of the two bits of a hash.
ONE, TWO = 0xB17, 0x2B17
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def damaged_words(docs: DataFrame, least: int = 6, divisor: int = 199) -> DataFrame:
    """(word, n): runs of letters of whole texts in small letters (A-Z only), where the crc32 h of `<doc_id>:<run>` is a multiple of
    `divisor` without the letter at h % length; those of at least `least` letters, with their number."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.expr(f"regexp_extract_all(text, '[{LETTERS}]{{{least},}}', 0)")).alias("run"))
    small = runs.select("d", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    hashed = small.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.when(F.col("h") % divisor == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(cut.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, one after another, and how many each has."""
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _value(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64), 0x5BE11)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]), dtype=np.uint64)


def _same_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points as a matrix) of the words of each length."""
    flat, sizes = _codes(words)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def hashes(words: pa.Array) -> np.ndarray:
    """The polynomial hash of each word."""
    out = np.zeros(len(words), np.uint64)
    for at, codes in _same_length(words):
        out[at] = (_value(codes) * _powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
    return out


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Of words of one length (a row of code points each): (kind, place, hashes by word and letter, which of them count) of all
    strings one edit away. Kinds: delete (one column), replace, insert (before the place)."""
    size = codes.shape[1]
    power, value = _powers(size + 1), _value(codes)
    before = np.zeros((len(codes), size + 1), np.uint64)  # hash of what stands before a place
    before[:, 1:] = np.cumsum(value * power[:size], axis=1, dtype=np.uint64)
    after = np.zeros((len(codes), size + 1), np.uint64)  # hash of what follows from a place on, by itself
    for i in range(size - 1, -1, -1):
        after[:, i] = value[:, i] + _BASE * after[:, i + 1]
    letters = _value(alphabet)
    for i in range(size):
        ends_run = np.ones(len(codes), bool) if i + 1 == size else codes[:, i] != codes[:, i + 1]
        yield "delete", i, (before[:, i] + power[i] * after[:, i + 1])[:, None], ends_run[:, None]
        with_letter = before[:, i, None] + power[i] * (letters + _BASE * after[:, i + 1, None])
        yield "replace", i, with_letter, codes[:, i, None] != alphabet
    for i in range(size + 1):
        with_letter = before[:, i, None] + power[i] * (letters + _BASE * after[:, i, None])
        fresh = np.ones(with_letter.shape, bool) if i == size else codes[:, i, None] != alphabet
        yield "insert", i, with_letter, fresh


def _edited(codes: np.ndarray, kind: str, i: int, letters: np.ndarray) -> np.ndarray:
    """The strings themselves: rows of code points."""
    head, tail = codes[:, :i], codes[:, i if kind == "insert" else i + 1 :]
    return np.concatenate([head, tail] if kind == "delete" else [head, letters[:, None], tail], axis=1)


def _strings(rows: np.ndarray) -> list[str]:
    return np.ascontiguousarray(rows.astype("<u4")).view(f"<U{rows.shape[1]}").ravel().tolist()


def bit_map(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bit map of the words' hashes, of bits / 8 bytes, put together from blocks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column(0))
            at = np.unique(np.concatenate([mix(h, ONE), mix(h, TWO)]) & np.uint64(bits - 1)).astype(np.int64)
            block = at // BLOCK_BITS
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), pa.array((at % BLOCK_BITS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(block[heads].astype(np.int32)), lists], names=["block", "at"])

    def filled(table: pa.Table) -> pa.Table:
        one = np.zeros(BLOCK_BITS, bool)
        for chunk in table.column("at").chunks:
            one[chunk.flatten().to_numpy()] = True
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(one, bitorder="little").tobytes()])})

    blocks = vocabulary.select("word").mapInArrow(places, "block int, at array<int>").groupBy("block").applyInArrow(filled, "block int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        first = row["block"] * BLOCK_BITS // 8
        out[first : first + len(part)] = part[: len(out) - first]
    return out


def candidates(vocabulary: DataFrame, alphabet: Sequence[str], most_bits: int = MOST_BITS) -> DataFrame:
    """(candidate, word, n): the strings one edit away from each word that may be words, by the bit map."""
    size = vocabulary.count()
    bits = max(LEAST_BITS, min(most_bits, 1 << max(0, BITS_A_WORD * size - 1).bit_length()))
    known = vocabulary.sparkSession.sparkContext.broadcast(bit_map(vocabulary, bits).tobytes())
    letters = np.array([ord(c) for c in alphabet], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bit = np.frombuffer(known.value, np.uint8), np.uint8(1) << np.arange(8, dtype=np.uint8)

        def is_set(mixed: np.ndarray) -> np.ndarray:
            at = (mixed & np.uint64(bits - 1)).astype(np.int64)
            return held[at >> 3] & bit[at & 7] != 0

        for batch in batches:
            for own, codes in _same_length(batch.column(0)):
                step = max(1, CANDIDATES // max(1, len(letters)))
                for k in range(0, len(own), step):
                    part, at = codes[k : k + step], own[k : k + step]
                    found, of = [], []
                    for kind, i, h, counts in neighbourhood(part, letters):
                        some = np.flatnonzero(is_set(mix(h, ONE)) & counts)
                        some = some[is_set(mix(h.ravel()[some], TWO))]
                        if len(some):
                            w, c = np.divmod(some, h.shape[1])
                            found += _strings(_edited(part[w], kind, i, letters[c]))
                            of.append(at[w])
                    if found:
                        source = pa.array(np.concatenate(of))
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(0).take(source), batch.column(1).take(source)], names=["candidate", "word", "n"])
        release()

    dealt = vocabulary.select("word", "n").repartition(-(-max(1, size) // WORDS), F.col("word"))
    return dealt.mapInArrow(run, "candidate string, word string, n long")


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last one, by doubling. Forms mustn't run in circles."""
    reach = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reach
    raise RuntimeError("forms run in circles")


def group(vocabulary: DataFrame, ratio: int = 5, most_bits: int = MOST_BITS) -> DataFrame:
    """Each word of `vocabulary` (word, n): word, form, root, n, n_near, form_n."""
    chars = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(r["c"] for r in chars.collect())  # of a fixed set of letters
    near = candidates(vocabulary, alphabet, most_bits).join(vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("m")), "candidate")
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("order"), "candidate", "m")).alias("best"))
    variant = F.col("best.m") >= F.lit(ratio) * F.col("n")
    best = written(best.select("word", "n_near", F.when(variant, F.col("best.candidate")).alias("form"), F.when(variant, F.col("best.m")).alias("form_n")), "near")
    ends = roots(best.where("form IS NOT NULL"))
    joined = vocabulary.join(best, "word", "left").join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def variants(docs: DataFrame, least: int = 6, most_rare: int = 5, ratio: int = 5, divisor: int = 199) -> DataFrame:
    """The words of `docs` (doc_id, text) that occur `most_rare` times at least, with their forms and roots."""
    return group(written(damaged_words(docs, least, divisor).where(F.col("n") >= most_rare), "vocabulary"), ratio)
