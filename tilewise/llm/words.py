"""The words of texts as hashes, made on Arrow's byte buffers, and a small memory of rows for words.

A word is a run of other bytes than \\x20 and \\x09 to \\x0D. Its hash is the sum of its bytes' values, each times a factor
of its place in the word, mixed: 64 bits, or 128 where a wrong meeting would be a wrong result.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLOCK = 1 << 18


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_BYTE = np.arange(256)
_SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_LOWER = np.where((_BYTE >= ord("A")) & (_BYTE <= ord("Z")), _BYTE + 32, _BYTE)


class Words:
    """Of texts one after another: `data` their bytes, `starts` and `sizes` of the words (with the white space that follows),
    `counts` of words in each text, `keys` one or two arrays of hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, keys: int = 1):
        texts = pc.fill_null(texts, "")
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.data = data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        blank = _SPACE[data]
        begins = ~blank
        inner = begins[1:] & ~blank[:-1]  # goes on from the byte before
        cut = edges[(edges > 0) & (edges < len(data))]
        inner[cut - 1] = False
        begins[1:] &= ~inner
        self.starts = np.flatnonzero(begins)
        self.sizes = np.diff(np.append(self.starts, len(data)))
        self.counts = np.diff(np.searchsorted(self.starts, edges))
        self.keys = [np.zeros(len(self.starts), np.uint64) for _ in range(keys)]
        if not len(self.starts):
            return
        places = np.arange(int(self.sizes.max())).astype(np.uint64)
        values = [np.where(_SPACE, np.uint64(0), mix((_LOWER if lower else _BYTE).astype(np.uint64), 0xB17E + k)) for k in range(keys)]
        factors = [mix(places, 0xFAC7 + k) | np.uint64(1) for k in range(keys)]
        cuts = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(data), _BLOCK)), len(self.starts)))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            first, sizes = self.starts[lo], self.sizes[lo:hi]
            heads = self.starts[lo:hi] - first
            at = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
            own = data[first : first + len(at)]
            for k in range(keys):
                self.keys[k][lo:hi] = mix(np.add.reduceat(values[k][own] * factors[k][at], heads), 0x3A5E)

    def strings(self, which: np.ndarray) -> list[str]:
        """The words themselves."""
        sizes = self.sizes[which] + 1  # white space between
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = at < np.repeat(sizes - 1, sizes)
        out = np.full(len(at), ord("\n"), np.uint8)
        out[own] = self.data[(np.repeat(self.starts[which], sizes) + at)[own]]
        return b"\n".join(out.tobytes().split()).decode().split("\n") if len(which) else []


class Memory:
    """Row numbers of words by their 128-bit hashes, in arrays: 20 bytes a word."""

    def __init__(self):
        self.key, self.check, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.key)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The rows, -1 for words that aren't known."""
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), self.row[at], -1).astype(np.int64)

    def add(self, key: np.ndarray, check: np.ndarray, row: np.ndarray) -> None:
        """New words, each once."""
        order = np.argsort(key)
        at = np.searchsorted(self.key, key[order])
        self.key, self.check, self.row = (np.insert(own, at, new[order]) for own, new in ((self.key, key), (self.check, check), (self.row, row.astype(np.int32))))


def release() -> None:
    """Hands freed memory back to the system, where the C library can: a worker lives on after its task, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
