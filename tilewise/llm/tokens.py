"""Token ids of whole texts, by a public tokenizer, with a bounded memory of words.

The tokenizer of `word_bpe_49k.json` drops white space and never joins characters across it, so
a text's ids are the ids of its words one after another. Words repeat far more than texts do:
each Python worker keeps the ids of the words it has met (at most `MAX_WORDS`, then it starts
anew) in arrays by their hashes, and asks the library only for new ones. Texts in which that could
change the result are handed to the library whole. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Memory, Words

MAX_WORDS = 700_000
#: Bytes of text that are split into words at a time, and texts.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 1 << 15
_JOINED = 256
#: What Python calls white space and the tokenizer doesn't, and what may hold a special token.
_WHOLE = r"[\x1c-\x1f]|<\|"
_MARK = "\x01"

_held: dict[tuple, object] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for one vocabulary file; made once for each Python process."""
    path = path or tokenizer_path()
    return held(("encoder", path), lambda: WordEncoder(path))


def held(key: tuple, make: Callable):
    """What a worker keeps between tasks: one thing at a time, so that stages one after another don't fill its memory."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """Lets go of what a stage before this one has left in the worker."""
    _held.clear()


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(place, slice) with about `most` bytes of text in each slice, and `CHUNK_TEXTS` texts at most; one longer text stands alone."""
    if len(texts) == 0:
        return
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        last = max(first + 1, min(first + CHUNK_TEXTS, int(np.searchsorted(size, before + most, side="right"))))
        yield first, texts.slice(first, last - first)
        first = last


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = self.library.encode(_MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.known = Memory()
        self.starts = np.zeros(1 << 16, np.int32)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum())), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _library, for words: many in each call, set apart by a mark."""
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        flat, sizes = [], []
        for group, e in zip(groups, self.library.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(group) - 1:
                ids, own = self._library(group)
                flat.append(ids)
                sizes.append(own)
                continue
            flat.append(np.delete(ids, cuts))
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def _keep(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The rows of new words with the ids `flat`."""
        first, n = len(self.known), len(key)
        while first + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.lengths[first : first + n] = sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        rows = np.arange(first, first + n)
        self.known.add(key, check, rows)
        return rows

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words, joined where that is safe."""
        odd = np.array([_MARK in w or len(self.mark) != 1 for w in words])
        if not odd.any():
            return self._joined(words)
        return self._library(words)

    def _stems(self, words: list[str]) -> np.ndarray:
        """Rows of distinct words, which the library is asked for where they aren't known."""
        own = Words(pa.array(words), keys=2)
        rows = self.known.find(*own.keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._keep(own.keys[0][new], own.keys[1][new], *self._ask([words[i] for i in new]))
        return rows

    def _learn(self, words: list[str], key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The rows of distinct new words."""
        rows = np.zeros(len(words), np.int64)
        # a stop or comma after a letter is a pre-token of its own
        split = np.array([w[-1:] in (".", ",") and w[-2:-1].isalpha() and w[-2] < "Ā" for w in words])
        plain, ended = np.flatnonzero(~split), np.flatnonzero(split)
        if len(plain):
            rows[plain] = self._keep(key[plain], check[plain], *self._ask([words[i] for i in plain]))
        if len(ended):
            stems = sorted({words[i][:-1] for i in ended} | {".", ","})
            place = {w: n for n, w in enumerate(stems)}
            known = self._stems(stems)
            pairs = np.array([(known[place[words[i][:-1]]], known[place[words[i][-1]]]) for i in ended], np.int64).ravel()
            sizes = self.lengths[pairs].astype(np.int64)
            rows[ended] = self._keep(key[ended], check[ended], self._gather(pairs, sizes), sizes.reshape(-1, 2).sum(axis=1))
        return rows

    def _gather(self, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[index] - ends + sizes, sizes)]

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts, keys=2)
        key, first, inverse = np.unique(words.keys[0], return_index=True, return_inverse=True)
        check = words.keys[1][first]
        if (words.keys[1] != check[inverse]).any():  # two words of one hash
            return self._library(texts.to_pylist())
        rows = self.known.find(key, check)
        new = np.flatnonzero(rows < 0)
        if len(new):
            if len(self.known) and len(self.known) + len(new) > MAX_WORDS:
                self._clear()
                new = np.arange(len(key))
            rows[new] = self._learn(words.strings(first[new]), key[new], check[new])
        index = rows[inverse]
        sizes = self.lengths[index].astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(words.counts)])]
        return self._gather(index, sizes), np.diff(edges)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another as unsigned 32-bit integers, and how many each text has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_words(texts)
        sizes, parts = np.zeros(len(texts), np.int64), []
        for own in (whole, ~whole):
            at = np.flatnonzero(own)
            if len(at):
                some = texts.take(pa.array(at))
                ids, sizes[at] = self._library(some.to_pylist()) if own is whole else self._by_words(some)
                parts.append((at, ids))
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for at, ids in parts:
            n = sizes[at]
            ends = np.cumsum(n)
            out[np.arange(len(ids)) + np.repeat(starts[at] - ends + n, n)] = ids
        return out, sizes


def encode_lists(texts: list[str | None], path: str | None = None) -> list[np.ndarray]:
    """The ids of each text."""
    ids, sizes = encoder(path).encode(pa.array(texts, pa.string()))
    return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []
