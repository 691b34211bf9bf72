"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment (operator 5).

A passage is a window of `WINDOW` signs of an item (the whole item, if it is shorter) that a text
holds with at most `EDITS` edits (in proportion fewer for shorter items). Such a window shares at
least WINDOW - q + 1 - q * EDITS q-grams with the text, on diagonals that differ by at most
2 * EDITS. Shared q-grams are counted in overlapping bands of diagonals; where a band holds that
many within a window's length, every window that could hold them is verified by banded alignment.
Case (below U+0600) and kinds of white space don't count.

Text is scanned once for each block of the benchmark of at most `BLOCK_CHARS` signs; the index of a
block goes to every executor, so its size is bounded, and a benchmark of any size is handled.

Defined cases: null and empty texts and items match nothing; items of q signs or fewer are matched
exactly by `leaks`, as whole words, and are no reason for `clean` to take a document away, as so
little text is met by chance; repeated rows are reported each; repeated items by their item_id;
empty tables give no rows; extra columns are ignored by `leaks` and kept by `clean`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .storage import written
from .words import release

Q, WINDOW, EDITS = 12, 100, 6
BLOCK_CHARS = 2_000_000
_GAP = np.uint32(0xFFFFFFFF)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def _lower() -> np.ndarray:
    table = np.arange(0x600, dtype=np.uint32)
    for c in range(0x600):
        low = chr(c).lower()
        table[c] = ord(" ") if chr(c).isspace() else ord(low) if len(low) == 1 else c
    return table


_LOWER = _lower()
#: White space above the table.
_BLANKS = np.array([c for c in range(0x600, 0x3001) if chr(c).isspace()], np.uint32)


def signs(text: str) -> np.ndarray:
    """Code points, one for each sign of the text: lower case, white space as blanks."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.where(points < len(_LOWER), _LOWER[np.minimum(points, len(_LOWER) - 1)], points).astype(np.uint32)
    far = np.flatnonzero(points >= len(_LOWER))
    if len(far):
        found[far] = np.where(np.isin(found[far], _BLANKS), ord(" "), found[far])
    return found


def qgram_hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the Q = 12 signs from each place on."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        f1, f2, f4 = _FACTOR, _FACTOR * _FACTOR, _FACTOR * _FACTOR * _FACTOR * _FACTOR
        h = points.astype(np.uint64) + np.uint64(1)
        h = h[:-1] * f1 + h[1:]
        h4 = h[:-2] * f2 + h[2:]
        h = h4[:-4] * f4 + h4[4:]
        h = h[:-4] * f4 + h4[8:]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


def _string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        own = [(i, signs(t)) for i, t in items if t and len(t) > Q]
        self.short: dict[str, list[int]] = {}  # text -> items
        for i, t in items:
            if t and len(t) <= Q:
                self.short.setdefault(_string(signs(t)), []).append(i)
        self.automaton = None
        if self.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t in self.short:
                self.automaton.add_word(t, t)
            self.automaton.make_automaton()
        self.ids = np.array([i for i, _ in own], np.int64)
        self.texts = [t for _, t in own]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.length, self.window = m, np.minimum(m, WINDOW)
        self.edits = np.minimum(self.window * EDITS // WINDOW, (self.window - Q) // Q)
        self.least = self.window - Q + 1 - Q * self.edits
        hashes = [qgram_hashes(t) for t in self.texts]
        n = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(flat, kind="stable")
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.first, self.count = first, np.diff(np.append(first, len(flat)))
        self.item, self.place = item[order], place[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.flat = np.concatenate(self.texts) if own else np.zeros(0, np.uint32)
        self.base = np.cumsum(m) - m

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in points, item, place in item) of all shared q-grams."""
        h = qgram_hashes(points)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return (np.zeros(0, np.int64),) * 3
        slot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[slot] == h[at]
        at, slot = at[same], slot[same]
        n = self.count[slot]
        entry = np.repeat(self.first[slot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.repeat(at, n), self.item[entry], self.place[entry]

    def candidates(self, place: np.ndarray, item: np.ndarray, own: np.ndarray, doc: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
        """Rows (doc, item, first diagonal of the band, first sign of the window) to verify."""
        step = 2 * self.edits[item] + 1
        diagonal = place - doc_start[doc] - own
        band = np.floor_divide(diagonal, step)
        doc, item, own, band = np.tile(doc, 2), np.tile(item, 2), np.tile(own, 2), np.concatenate([band, band - 1])
        order = np.lexsort((own, band, item, doc))
        doc, item, own, band = doc[order], item[order], own[order], band[order]
        i = np.arange(len(doc))
        j = i + self.least[item] - 1
        fits = j < len(doc)
        i, j = i[fits], j[fits]
        fits = (doc[i] == doc[j]) & (item[i] == item[j]) & (band[i] == band[j]) & (own[j] - own[i] <= self.window[item[i]] - Q)
        i, j = i[fits], j[fits]
        if not len(i):
            return np.zeros((0, 4), np.int64)
        lo = np.maximum(own[j] + Q - self.window[item[i]], 0)
        hi = np.minimum(own[i], self.length[item[i]] - self.window[item[i]])
        lo = np.minimum(lo, hi)
        # hits side by side allow mostly the same windows: each adds those beyond the last one's
        follows = (doc[i][1:] == doc[i][:-1]) & (item[i][1:] == item[i][:-1]) & (band[i][1:] == band[i][:-1])
        lo[1:] = np.where(follows & (hi[:-1] >= lo[1:]), hi[:-1] + 1, lo[1:])
        n = np.maximum(hi - lo + 1, 0)
        k = np.repeat(np.arange(len(i)), n)
        start = lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        i = i[k]
        rows = np.stack([doc[i], item[i], band[i] * (2 * self.edits[item[i]] + 1), start], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]

    def align(self, points: np.ndarray, doc_start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each candidate the fewest edits of its window within its band, and where the text's part starts and ends."""
        k = int(self.edits[rows[:, 1]].max())
        width = 2 * (2 * k + 1) + 2 * k + 1
        item, start = rows[:, 1], rows[:, 3]
        base = doc_start[rows[:, 0]] + rows[:, 2] + start - k
        x = np.arange(width)
        cost = np.zeros((len(rows), width), np.int32)
        origin = base[:, None] + x
        best, best_from, best_to = np.full(len(rows), 1 << 20), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        window = self.window[item]
        for r in range(int(window.max())):
            sign = self.flat[self.base[item] + np.minimum(start + r, self.length[item] - 1)]
            at = base[:, None] + r + x
            inside = (at >= 0) & (at < len(points))
            unlike = (points[np.clip(at, 0, len(points) - 1)] != sign[:, None]) | ~inside
            new, from_ = cost + unlike, origin
            skip = np.full_like(cost, 1 << 20)
            skip[:, :-1] = cost[:, 1:] + 1
            less = skip < new
            new = np.where(less, skip, new)
            from_ = np.where(less, np.roll(origin, -1, axis=1), from_)
            # signs of the text that the window lacks: a running minimum along the row
            sunk = new - x
            low = np.minimum.accumulate(sunk, axis=1)
            source = np.maximum.accumulate(np.where(sunk == low, x, 0), axis=1)
            cost, origin = low + x, np.take_along_axis(from_, source, axis=1)
            ends = np.flatnonzero(window == r + 1)
            if len(ends):
                c = cost[ends].argmin(axis=1)
                best[ends], best_from[ends], best_to[ends] = cost[ends, c], origin[ends, c], base[ends] + r + c + 1
        return best, best_from, best_to

    def find_short(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text, item_id, start, end) once for each text and item of Q signs or fewer that it holds as whole words."""
        out = []
        for k, t in enumerate(texts if self.short else []):
            plain, seen = _string(signs(t or "")), set()
            for last, item in self.automaton.iter(plain):
                at, end = last + 1 - len(item), last + 1
                if item in seen or plain[max(0, at - 1) : at].isalnum() and item[0].isalnum() or plain[end : end + 1].isalnum() and item[-1].isalnum():
                    continue
                seen.add(item)
                out += [(k, i, at, end) for i in self.short[item]]
        return out

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) once for each text and item where a window passes; the first that does."""
        points, doc_start, at = [], [], 0
        gap = np.full(4 * EDITS + Q, _GAP)
        for t in texts:
            doc_start.append(at)
            if t:
                points.append(signs(t))
                at += len(points[-1])
            points.append(gap)
            at += len(gap)
        starts = np.array(doc_start, np.int64)
        flat = np.concatenate(points) if points else gap
        place, item, own = self.hits(flat)
        if not len(place):
            return []
        doc = np.searchsorted(starts, place, side="right") - 1
        rows = self.candidates(place, item, own, doc, starts)
        out = []
        while len(rows):
            group = rows[:, 0] * len(self.ids) + rows[:, 1]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            number = np.arange(len(rows)) - heads[np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))]
            now = number < 8
            tried = rows[now]
            done: set[int] = set()
            for k in range(0, len(tried), 2048):
                part = tried[k : k + 2048]
                edits, from_, to = self.align(flat, starts, part)
                for r, e, a, b in zip(part, edits, from_, to):
                    key = int(r[0] * len(self.ids) + r[1])
                    if e <= self.edits[r[1]] and key not in done:
                        done.add(key)
                        out.append((int(r[0]), int(r[1]), int(e), int(a - starts[r[0]]), int(b - starts[r[0]])))
            rows = rows[~now]
            if done and len(rows):
                rows = rows[~np.isin(rows[:, 0] * len(self.ids) + rows[:, 1], list(done))]
        return out


def _scan(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS signs, or one item
    key = ("passages", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = tokens.held(key, lambda: Index(shared.value))
        for batch in batches:
            for first, texts in tokens.chunks(batch.column(1), 1 << 20):
                plain = texts.to_pylist()
                found = [(doc, int(index.ids[item]), *rest) for doc, item, *rest in index.find(plain)]
                found += [(doc, item, 0, start, end) for doc, item, start, end in index.find_short(plain)]
                if found:
                    doc, *rest = map(np.array, zip(*found))
                    values = [batch.column(0).take(pa.array(first + doc)), *map(pa.array, rest)]
                    yield pa.RecordBatch.from_arrays(values, names=["doc_id", "item_id", "edits", "span_start", "span_end"])
            release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, item_id long, edits long, span_start long, span_end long")


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document of `docs` (doc_id, text) and item of `benchmark` (item_id, text) that it holds a passage of:
    doc_id, item_id, edits, span_start, span_end (signs of the text, end exclusive)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.select(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-2 * size // block_chars)) if size > block_chars else 1
    blocks = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n))
    return reduce(DataFrame.union, [_scan(docs, sorted((r["item_id"], r["text"]) for r in b.collect())) for b in blocks])


def clean(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage. Rows without doc_id stay. Items of `Q` signs or fewer, which ordinary
    texts hold as well, only count with `short`."""
    found = written(leaks(docs, benchmark if short else benchmark.where(F.length("text") > Q)).select(F.col("doc_id").alias("__leaked")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"].cast("long") == F.col("__leaked"), "left_anti")
