"""Best-fit packing of token sequences by fitted length patterns (operator 1).

1. Documents are tokenised, ended by an end id and cut into pieces of at most `capacity` ids.
2. The histogram of piece lengths (at most `capacity` entries, whatever the corpus) goes to the driver.
3. `fit_patterns`: patterns of at most `depth` lengths, each from a class of similar lengths, are
   enumerated; a non-negative least-squares fit of their repeat counts to the histogram of classes
   is rounded down and realised with exact lengths, the last place of a pattern taking the longest
   length that fits.
4. Residual pieces, longest first, go to the fullest sequence with room for them (best fit), first
   of all into what the patterns left free. All of this works on counts of equal lengths.
5. The plan says for each length which of its pieces (by rank) go where. Ranks within a length
   come from counts by (length, salt), so that a very common length is spread over many tasks.

Defined cases: null text is an empty text, which packs as its end id alone; an empty table gives
no rows; each row is a document of its own, also where several share a doc_id: their pieces have
places of their own, but nothing in the result says which of those rows a piece is from; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .storage import written
from .words import release

CAPACITY = 4096
END_ID = 1
#: Pieces of one (length, salt) group, about, while there are at most GROUPS groups besides one for each length.
RANKED, GROUPS = 500, 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document (doc_id, text): its place, length and checksum, with `keep_ids` its ids too."""
    path = path or tokens.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            for first, texts in tokens.chunks(batch.column(1)):
                ids, sizes = enc.encode(texts)
                ends = np.cumsum(sizes)
                flat = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
                sizes = sizes + 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                crc = np.fromiter((zlib.crc32(flat[a : a + n]) for a, n in zip(at, length)), np.int64, len(doc))
                out = [batch.column(0).slice(first, len(texts)).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
                if keep_ids:
                    edges = np.concatenate([np.cumsum(length) - length, [len(flat)]]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])
            release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


# -- the plan: all of it on counts of lengths ------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Non-negative least squares by active sets: x >= 0 with the least |a x - b|."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    scale = max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0] + 10):
        slope = target - gram @ x
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * scale:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[at] = old + step * (z - old)
            gone = at[(x[at] <= 1e-12 * scale) & low]
            if not len(gone):
                gone = at[low]
            x[gone] = 0
            used[gone] = False
            if not used.any():
                break
    return x


def enumerate_patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most `depth` of the classes 1..`classes` that add up to `classes`."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, least: int, own: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(own)
        elif len(own) < depth:
            for c in range(least, rest + 1):
                grow(rest - c, c, (*own, c))

    grow(classes, 1, ())
    return out


class Plan:
    """Groups of equal sequences: (lengths, count). Counts can be large; the number of groups follows the histogram's size."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[list]] = defaultdict(list)  # by free room: [lengths, count]
        self.full: list[list] = []

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        free = self.capacity - sum(lengths)
        (self.open[free] if free else self.full).append([lengths, count])

    def groups(self) -> list[list]:
        return self.full + [g for gs in self.open.values() for g in gs]


def fit_patterns(histogram: dict[int, int], capacity: int, classes: int, depth: int, slack: int) -> tuple[Plan, dict[int, int]]:
    """Sequences made of fitted patterns, and the counts of the lengths that are left over."""
    plan, left = Plan(capacity), dict(histogram)
    if left.get(capacity):
        plan.add((capacity,), left.pop(capacity))
    width = capacity / classes
    class_of = {n: min(classes, max(1, round(n / width))) for n in left}
    patterns = [p for p in enumerate_patterns(classes, depth) if len(p) > 1]
    goal = np.zeros(classes)
    for n, c in left.items():
        goal[class_of[n] - 1] += c
    held = {i + 1 for i in np.flatnonzero(goal)}
    patterns = [p for p in patterns if held.issuperset(p)]
    if not patterns:
        return plan, left
    a = np.zeros((classes, len(patterns)))
    for j, p in enumerate(patterns):
        for c in p:
            a[c - 1, j] += 1
    repeats = np.floor(nnls(a, goal) + 1e-6).astype(np.int64)
    by_class: dict[int, dict[int, int]] = defaultdict(dict)
    for n, c in left.items():
        by_class[class_of[n]][n] = c
    for j in np.argsort(-repeats, kind="stable"):
        want, p = int(repeats[j]), patterns[j]
        while want > 0:
            chosen: list[int] = []
            for c in p[:-1]:
                own = by_class[c]
                n = max((n for n in own if own[n] > chosen.count(n)), key=lambda n: (own[n], n), default=0)
                if not n:
                    break
                chosen.append(n)
            if len(chosen) < len(p) - 1:
                break
            rest, own = capacity - sum(chosen), by_class[p[-1]]
            last = max((n for n in own if n <= rest and own[n] > chosen.count(n)), default=0)
            if not last or rest - last > slack:
                # no partner for these: the pattern's other pieces are left for the residual stage
                n = chosen[-1]
                by_class[p[-2]] = {k: v for k, v in by_class[p[-2]].items() if k != n}
                continue
            chosen.append(last)
            classes_of = dict(zip(chosen, p))
            count = min(want, *(by_class[classes_of[n]][n] // chosen.count(n) for n in set(chosen)))
            plan.add(tuple(chosen), count)
            want -= count
            for n in chosen:
                left[n] -= count
                by_class[classes_of[n]][n] -= count
    return plan, {n: c for n, c in left.items() if c}


def best_fit(plan: Plan, left: dict[int, int]) -> None:
    """Puts what is left, longest first, where least room stays free; opens sequences where none has room."""
    room = np.zeros(plan.capacity + 1, bool)
    for free, gs in plan.open.items():
        room[free] = bool(gs)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            fits = np.flatnonzero(room[n:])
            if not len(fits):
                each = plan.capacity // n
                whole, some = divmod(count, each)
                for k, times in ((each, whole), (some, 1)):
                    if k and times:
                        plan.add((n,) * k, times)
                        room[plan.capacity - n * k] |= n * k < plan.capacity
                break
            free = int(fits[0]) + n
            lengths, have = plan.open[free].pop()
            room[free] = bool(plan.open[free])
            each = min(free // n, count)
            times = min(have, count // each)
            if have > times:
                plan.open[free].append([lengths, have - times])
                room[free] = True
            plan.add((*lengths, *(n,) * each), times)
            rest = free - n * each
            if rest:
                room[rest] = True
            count -= each * times


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = 32, depth: int = 4, slack: int = 1) -> dict[str, np.ndarray]:
    """Places for the pieces of each length, by rank: from `rank` on, `count` pieces of `length` go to the sequences from
    `sequence` on, at `offset`. Sorted by length and rank."""
    plan, left = fit_patterns(histogram, capacity, classes, depth, slack)
    best_fit(plan, left)
    rows, ranks, sequence = [], defaultdict(int), 0
    for lengths, count in plan.groups():
        offset = 0
        for n in lengths:
            rows.append((n, ranks[n], count, sequence, offset))
            ranks[n] += count
            offset += n
        sequence += count
    assert dict(ranks) == {n: c for n, c in histogram.items() if c}
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "sequence", "offset"), table.T)) | {"sequences": np.int64(sequence)}


# -- on Spark ----------------------------------------------------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """`pieces` (with a column `length` of 1 to `capacity`) with sequence_id and offset. `pieces` should be a written table:
    it is read twice."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = make_plan(histogram, capacity)
    ranked = max(RANKED, sum(histogram.values()) // GROUPS)
    salts = spark.createDataFrame([(n, -(-c // ranked)) for n, c in histogram.items()], "length long, _salts int")
    salt = F.pmod(F.xxhash64(*order), F.col("_salts")).cast("int")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", salt)  # as small as the histogram
    counts = sorted((r["length"], r["_salt"], r["count"]) for r in salted.groupBy("length", "_salt").count().collect())
    n = np.array(counts, np.int64).reshape(-1, 3)
    before = np.cumsum(n[:, 2]) - n[:, 2]
    first = np.zeros(len(n), np.int64)
    if len(n):
        heads = np.flatnonzero(np.concatenate([[True], n[1:, 0] != n[:-1, 0]]))
        first = before - before[heads][np.cumsum(np.concatenate([[True], n[1:, 0] != n[:-1, 0]])) - 1]
    shared = spark.sparkContext.broadcast((plan, n[:, 0] * (1 << 20) + n[:, 1], first))
    names = pieces.columns
    keys = [names.index("length"), len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, groups, first = shared.value
        slot = plan["length"] * (1 << 40) + plan["rank"]
        last, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys)
            key = length * (1 << 20) + salt
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            run_of = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
            number = np.arange(len(key)) - heads[run_of]
            if key[0] == last:
                number[run_of == 0] += seen
            last, seen = int(key[-1]), int(number[-1]) + 1
            rank = first[np.searchsorted(groups, key)] + number
            at = np.searchsorted(slot, length * (1 << 40) + rank, side="right") - 1
            sequence = plan["sequence"][at] + rank - plan["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(plan["offset"][at])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    dealt = salted.select(*names, "_salt").repartition("length", "_salt").sortWithinPartitions("length", "_salt", *order)
    return dealt.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every piece of every document of `docs` (doc_id, text) with its place: sequence_id and offset."""
    return place(written(tokenised(docs, capacity, end_id, path), "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most `capacity`), and the doc_id and offset of each piece in it."""
    kept = written(tokenised(docs, capacity, end_id, path, keep_ids=True), "pieces")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most `capacity` pieces
    return (
        place(kept, capacity).groupBy("sequence_id").agg(parts.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.expr("transform(parts, p -> struct(p.doc_id, p.piece, p.offset))").alias("documents"))
    )
