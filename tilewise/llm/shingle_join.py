"""Jaccard join of word shingles by PartEnum signatures (operator 10).

A document's set is the hashes of its distinct shingles. Sets of equal size bands can be similar
only to sets of their own and the next band. For a band with largest size r, two sets that reach
the threshold differ in at most k = 2 r (1 - t) / (1 + t) elements. The domain is cut into n1 parts,
a little over (k + 1) / 2, so that some part of two similar sets differs in one element at most.
Each part is cut into n2 = 3 smaller ones, and its signatures are its subsets of two of these: the
one that leaves out the odd element is alike in both. No more than 2 min(k, n1) + max(0, k - n1)
signatures of two similar sets differ, so each set needs only the fullest of them, one more than
that: the fullest of those that are alike in both is among these in both, and no signature of
empty parts brings strangers together.

Equal sets are one vertex from the start (the smallest doc_id stands for them). Signatures that
several vertices have are buckets; they are settled in rounds, and after each the graph is
contracted to its components. First each vertex is checked against the smallest vertex of its
buckets only. Then only buckets that hold vertices of different components are left, of those
with the same vertices one. In each of these, pairs of different components are told apart by sizes
and by odd sketches (each element flips a bit; sets differ in at least as many elements as sketches
in bits), in the task, and of what is possible each vertex puts forward its nearest few, in the last
round all. These are checked exactly by intersecting the sets. So neither copies nor near copies
are expanded into pairs: what is linked already isn't met again, and a large bucket is dealt out
in pairs of blocks.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than a shingle has are one shorter shingle; repeated rows are repeated in the
result; rows that share a doc_id are placed by their own text; a null doc_id links nothing by
itself and gets the component of its equal texts, or null; an empty table gives no rows; extra
columns are ignored. Shingles and vertices are told apart by 64-bit hashes, sets by 128 bits and
their size. Signatures travel in 48 bits and their part; two that fall together only make candidates more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .storage import settled, written
from .words import Words, release
from .words import mix as _mix

#: Bits of the smallest sketch; larger sets have the power of two that is twice their size at least.
LEAST_BITS = 1024
#: Up to as many ids are sent to every executor (8 bytes each); beyond that texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Signatures that one task sends at a time, and that one task brings together, about.
SENT, PART = 300_000, 300_000
#: Vertices of a bucket that one group holds, about; larger buckets are pairs of such blocks.
BLOCK = 1024
#: Sets that are handled at once, at most; `tokens.chunks` cuts batches of any size into fewer.
MOST_SETS = 1 << 16
#: How many partners a vertex puts forward in each round of a bucket; None: all.
ROUNDS = (2, None)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of `sizes` values."""
    out, full = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _few(n: int) -> None:
    if n > MOST_SETS:
        raise ValueError(f"at most {MOST_SETS} sets at once: their numbers share 64 bits with hashes")


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, one text after another, and how many each has. `MOST_SETS` texts at most."""
    _few(len(texts))
    own = Words(texts, lower=True)
    word, count = own.keys[0], own.counts
    owner, ends = np.repeat(np.arange(len(texts)), count), np.cumsum(count)
    factors = [_mix(np.array([j + 1], np.uint64), 0x5EED) | np.uint64(1) for j in range(words)]
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j, f in enumerate(factors):
        rolled += word[j : j + len(rolled)] * f
    whole = np.flatnonzero(np.arange(len(rolled)) + words <= ends[owner[: len(rolled)]])
    values, of = [_mix(rolled[whole], words)], [owner[whole]]
    for n in range(1, words):  # texts of fewer words
        own = np.flatnonzero(count == n)
        first = ends[own] - n
        values.append(_mix(sum((word[first + j] * factors[j] for j in range(n)), np.zeros(len(own), np.uint64)), n))
        of.append(own)
    h, own = np.concatenate(values), np.concatenate(of)
    order = np.argsort((own.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    h, own = h[order], own[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[fresh], np.bincount(own[fresh], minlength=len(texts))


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size and last size of each band, and the elements in which similar sets of it and the band before differ at most."""
    first, last = [1], [100 // percent]
    while last[-1] < most:
        first.append(last[-1] + 1)
        last.append(first[-1] * 100 // percent)
    last_ = np.array(last, np.int64)
    return np.array(first, np.int64), last_, 2 * last_ * (100 - percent) // (100 + percent)


def signatures(values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets (one after another in `values`), in order of the sets, and how many each has. `MOST_SETS` at most."""
    _few(len(sizes))
    first, _, differ = bands(percent, int(sizes.max(initial=1)) * 100 // percent + 1)
    band = np.maximum(np.searchsorted(first, sizes, side="right") - 1, 0)
    set_of = np.repeat(np.arange(len(sizes)), sizes)
    hashed = _mix(values, 0x51ED27)
    owners, found = [], []
    for step in (0, 1):
        at = band + step
        k = np.where(sizes > 0, differ[at], 0)
        parts = np.where(k == 0, 1, (6 * (k + 1) + 9) // 10) * (sizes > 0)
        kept = np.where(k == 0, 1, 2 * np.minimum(k, parts) + np.maximum(0, k - parts) + 1) * (sizes > 0)
        slots = 3 * parts
        base = np.cumsum(slots) - slots
        slot = base[set_of] + (_mix(hashed + at[set_of].astype(np.uint64), 0xA5A5) % slots[set_of].astype(np.uint64)).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), slots)
        sums, filled = np.zeros(len(owner), np.uint64), np.bincount(slot, minlength=len(owner))
        np.add.at(sums, slot, hashed)
        sums, filled = sums.reshape(-1, 3), filled.reshape(-1, 3)
        two, within = (sums.sum(axis=1, keepdims=True) - sums).ravel(), (filled.sum(axis=1, keepdims=True) - filled).ravel()
        equal = (k == 0)[owner]  # only equal sets are similar: the first signature is the whole set
        two, within = np.where(equal, np.repeat(sums.sum(axis=1), 3), two), np.where(equal, 0, within)
        number = np.arange(len(owner)) - base[owner]
        label = (at[owner].astype(np.uint64) << np.uint64(40)) + np.where(equal, 0, number).astype(np.uint64)
        sig = _mix(two + _mix(label, 0xBEEF), 0x77)
        # of each set the fullest, ties by the signature: what two sets have alike they decide alike
        order = np.argsort((owner.astype(np.uint64) << np.uint64(48)) | ((np.uint64(255) - np.minimum(within, 255).astype(np.uint64)) << np.uint64(40)) | (sig >> np.uint64(24)), kind="stable")
        best = order[number < kept[owner]]
        found.append(sig[best])
        owners.append(owner[best])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found)[order], np.bincount(np.concatenate(owners), minlength=len(sizes))


def _prints(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; the first names a vertex."""
    return _sums(_mix(values, 0x1234567), sizes), _sums(_mix(values, 0x7654321), sizes)


class Sketches:
    """Odd sketches, one after another in `pool`; the length of each is a power of two."""

    def __init__(self, pool: np.ndarray, words: np.ndarray):
        self.pool, self.words, self.starts = pool, words, np.cumsum(words) - words

    @staticmethod
    def of(values: np.ndarray, sizes: np.ndarray) -> Sketches:
        bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
        own = Sketches(np.zeros(int(bits.sum()) // 64, np.uint64), bits // 64)
        h = _mix(values, 0x0DD)
        at = (h & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(own.pool, np.repeat(own.starts, sizes) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        return own

    @staticmethod
    def read(column: pa.Array) -> Sketches:
        parts = column.to_pylist()
        return Sketches(np.frombuffer(b"".join(parts), np.uint64), np.array([len(x) // 8 for x in parts], np.int64))

    def column(self) -> pa.Array:
        data = self.pool.tobytes()
        return pa.array([data[8 * s : 8 * (s + n)] for s, n in zip(self.starts.tolist(), self.words.tolist())], pa.binary())

    def _rows(self, i: np.ndarray, words: int, to: int) -> np.ndarray:
        rows = self.pool[self.starts[i][:, None] + np.arange(words)]
        return np.bitwise_xor.reduce(rows.reshape(len(i), words // to, to), axis=1)

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many elements the sets of each pair differ at least; a longer sketch is folded to the shorter one's length."""
        out = np.zeros(len(i), np.int64)
        a, b = self.words[i], self.words[j]
        for x, y in set(zip(a.tolist(), b.tolist())):
            at, n = np.flatnonzero((a == x) & (b == y)), max(1, (1 << 19) // max(x, y))
            for some in (at[k : k + n] for k in range(0, len(at), n)):
                w = min(x, y)
                out[some] = np.bitwise_count(self._rows(i[some], x, w) ^ self._rows(j[some], y, w)).sum(axis=1)
        return out


def _possible(n: np.ndarray, sketches: Sketches, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs sizes and sketches leave possible, and the share of the difference that they have used up."""
    ok = np.flatnonzero(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    used, most = sketches.differ(i[ok], j[ok]) * (100 + percent), (n[i[ok]] + n[j[ok]]) * (100 - percent)
    some = used <= most
    return ok[some], (used / most)[some]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _packed(sigs: np.ndarray, parts: int) -> bytes:
    """Signatures of one part, in six bytes each: the part itself says the rest, but for the highest bits where parts are few."""
    return np.ascontiguousarray((sigs // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Numbers that are alike for signatures that `_packed` made alike, and in one part only."""
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    return wide.view("<u8").ravel() * np.uint64(parts) + np.uint64(part)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return heads, np.diff(np.append(heads, len(keys)))


_TRAVEL = "p int, kind int, sigs binary, vs binary, doc_id long, n long, fp1 long, fp2 long, sketch binary"
_ARRIVE = "kind int, sig long, v long, least long, doc_id long, n long, fp1 long, fp2 long, sketch binary"
MET, SET, LOOSE = 0, 1, 2


def features(docs: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """From one pass over the texts, by `kind`. SET: doc_id, n, fp1, fp2, sketch of each row. MET: (sig, v, least), the signatures
    that several vertices have, with each of these, least being the smallest of those met with it; rows may repeat.

    Signatures travel packed, some thousands in a row. Those that meet within one task's batches are told apart before the
    shuffle: then only one of their vertices goes on, so that a signature of very many sets is no large group."""

    def empty(size: int, **given: pa.Array) -> pa.RecordBatch:
        fields = [x.split() for x in _TRAVEL.split(", ")]
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return _batch(**{name: given[name] if name in given else pa.nulls(size, kinds[kind]) for name, kind in fields})

    def chunks(sigs: np.ndarray, vs: np.ndarray) -> tuple[list, list, list, list]:
        """The signatures of one task's sets, packed: p, kind, sigs, vs."""
        order = np.argsort(sigs)
        sigs, vs = sigs[order], vs[order]
        heads, n = _runs(sigs)
        least = np.minimum.reduceat(vs, heads)
        met = np.repeat(least, n) != vs
        rows = []
        if met.any():
            s, v = sigs[met], np.stack([vs[met], np.repeat(least, n)[met]])
            part = (s % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, sizes = _runs(part[order])
            rows += [(int(part[own[0]]), MET, _packed(s[own], parts), v[:, own].tobytes()) for own in (order[k : k + m] for k, m in zip(at, sizes))]
        sigs = sigs[heads]
        part = (sigs % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, sizes = _runs(part[order])
        rows += [(int(part[own[0]]), LOOSE, _packed(sigs[own], parts), least[own].tobytes()) for own in (order[k : k + m] for k, m in zip(at, sizes))]
        return tuple(map(list, zip(*rows)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        held, count, turn = [], 0, 0

        def flush() -> pa.RecordBatch:
            p, kind, sigs, vs = chunks(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return empty(len(p), p=pa.array(p, pa.int32()), kind=pa.array(kind, pa.int32()), sigs=pa.array(sigs, pa.binary()), vs=pa.array(vs, pa.binary()))

        for batch in batches:
            for first, texts in tokens.chunks(batch.column(1)):
                values, sizes = shingles(texts, words)
                prints = _prints(values, sizes)
                m = len(texts)
                yield empty(m, p=pa.array((np.arange(turn, turn + m) * 7919 + len(values)) % parts, pa.int32()), kind=pa.array(np.full(m, SET), pa.int32()), doc_id=batch.column(0).slice(first, m), n=pa.array(sizes), fp1=_long(prints[0]), fp2=_long(prints[1]), sketch=Sketches.of(values, sizes).column())
                turn += m
                one = np.zeros(m, bool)
                one[np.unique(prints[0], return_index=True)[1]] = True
                one &= sizes > 0
                if one.any():
                    sigs, counts = signatures(values[np.repeat(one, sizes)], sizes[one], percent)
                    held.append((sigs, np.repeat(prints[0][one], counts)))
                    count += len(sigs)
                if count >= SENT:
                    yield flush()
                    count = 0
        if held:
            yield flush()
        release()

    def rows(of: int, size: int, **given: pa.Array) -> pa.RecordBatch:
        names = [x.split()[0] for x in _ARRIVE.split(", ")]
        every = {"kind": pa.array(np.full(size, of), pa.int32())} | given
        return _batch(**{k: every[k] if k in every else pa.nulls(size, pa.binary() if k == "sketch" else pa.int64()) for k in names})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, vs = [], []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            own = batch.filter(pa.array(kinds == SET))
            if own.num_rows:
                yield rows(SET, own.num_rows, **{k: own.column(k) for k in ("doc_id", "n", "fp1", "fp2", "sketch")})
            for k in np.flatnonzero(kinds != SET):
                sig, v = (np.frombuffer(batch.column(c)[k].as_buffer(), of) for c, of in (("sigs", np.uint8), ("vs", np.uint64)))
                sig = _unpacked(sig, batch.column("p")[k].as_py(), parts)
                if kinds[k] == MET:
                    both = v.reshape(2, -1)
                    # the smallest one itself is a member as well
                    yield rows(MET, 2 * len(sig), sig=_long(np.tile(sig, 2)), v=_long(both.ravel()), least=_long(np.tile(both[1], 2)))
                else:
                    sigs.append(sig)
                    vs.append(v)
        if sigs:
            sig, v = np.concatenate(sigs), np.concatenate(vs)
            sigs.clear(), vs.clear()
            order = np.argsort(sig)
            sig, v = sig[order], v[order]
            heads, n = _runs(sig)
            low, high = np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads)
            some = np.repeat(low != high, n)
            if some.any():
                yield rows(MET, int(some.sum()), sig=_long(sig[some]), v=_long(v[some]), least=_long(np.repeat(low, n)[some]))
            del sig, v, order, low, high, some
        release()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(send, _TRAVEL).repartitionById(parts, F.col("p")).mapInArrow(meet, _ARRIVE)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(v, set): the vertex of each text that isn't empty, and its shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in tokens.chunks(batch.column(0)):
                values, sizes = shingles(texts, words)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield _batch(v=_long(_prints(values, sizes)[0]), set=pa.ListArray.from_arrays(offsets, _long(values)))
        release()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "v long, set array<long>").where(F.size("set") > 0)


def similar(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets reach the threshold: 100 * intersection >= percent * union."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of vertices whose sets are similar."""
    a, b = (sets.select(F.col("v").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return written(pairs.join(a, "a").join(b, "b").where(similar(F.col("set_a"), F.col("set_b"), percent)).select("a", "b"), "links")


def _first_pairs(buckets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): each vertex with the smallest vertex of its buckets, where sizes and sketches leave it possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")])
            sketches = Sketches.read(pa.concat_arrays([batch.column("sketch"), batch.column("other")]))
            ok, _ = _possible(n, sketches, np.arange(m), np.arange(m) + m, percent)
            yield batch.select(["a", "b"]).take(pa.array(ok))
        release()

    star = buckets.where("v <> least").groupBy(F.col("v").alias("a")).agg(F.min("least").alias("b"))
    one, other = known.select(F.col("v").alias("a"), "n", "sketch"), known.select(F.col("v").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
    return star.join(one, "a").join(other, "b").select("a", "b", "n", "m", "sketch", "other").mapInArrow(run, "a long, b long")


def _open(buckets: DataFrame, part_of: DataFrame) -> DataFrame:
    """(sig, x, y, v, n, sketch, part): the vertices of buckets with several components. Of buckets with the same vertices one
    stays; x and y are the two blocks of a large bucket that meet."""
    placed = written(buckets.join(part_of, "v").select("sig", "v", "part"), "placed")
    mark = (F.bit_xor(F.xxhash64("v")), F.bit_xor(F.xxhash64("v", F.lit(1))))
    mixed = placed.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("v").alias("size"), *(x.alias(f"m{i}") for i, x in enumerate(mark)))
    mixed = mixed.where("p < q").groupBy("size", "m0", "m1").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("v"), F.col("blocks").cast("long")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), own))
    met = placed.join(mixed, "sig").select("sig", "v", own.alias("own"), F.explode(others).alias("other"))
    rows = met.join(part_of, "v")
    return rows.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "v", "n", "sketch", "part")


def _candidates(open_: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(a, b), a < b, not told apart: pairs of different components in one bucket that sizes and sketches leave possible; of each
    vertex's the nearest `most`, or all."""

    def pairs_of(group: pa.Table) -> pa.RecordBatch:
        """All rows of some whole buckets, which follow one another."""
        v, n, part = (group.column(c).to_numpy() for c in ("v", "n", "part"))
        starts, sizes = _runs_of(group)
        ends = np.repeat(starts + sizes, sizes)
        sketches = Sketches.read(group.column("sketch").combine_chunks())
        found, used = [], []
        for d in range(1, int(sizes.max(initial=1))):
            i = np.flatnonzero(np.arange(len(v)) + d < ends)
            i = i[part[i] != part[i + d]]
            ok, share = _possible(n, sketches, i, i + d, percent)
            found.append(np.stack([i[ok], i[ok] + d]))
            used.append(share)
        i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        if most and len(i):
            share, ends_ = np.concatenate(used), np.concatenate([i, j])
            order = np.lexsort((np.tile(share, 2), ends_))
            heads, m = _runs(ends_[order])
            rank = np.arange(len(order)) - np.repeat(heads, m)
            kept = np.unique(order[rank < most] % len(i))
            i, j = i[kept], j[kept]
        return _batch(a=_long(np.minimum(v[i], v[j])), b=_long(np.maximum(v[i], v[j])))

    def _runs_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        s, x, y = (group.column(c).to_numpy() for c in ("sig", "x", "y"))
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        heads = np.flatnonzero(fresh)
        return heads, np.diff(np.append(heads, len(s)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rest.num_rows:
                continue
            last = int(_runs_of(rest)[0][-1])
            if last:
                yield pairs_of(rest.slice(0, last))
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield pairs_of(rest)
        del rest
        release()

    return open_.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Each row of `docs` (doc_id, text): doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id
    (smallest doc_id reachable by links of similar sets). Written; the tables of the rounds are gone by then."""
    return settled(lambda: _linked(docs, words, percent), "linked")


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(64, int(characters / 5 * 3.2 * (100 - percent) / (100 + percent)) // PART)
    found = written(features(docs, words, percent, parts), "features", "kind")
    every, buckets = found.where(F.col("kind") == SET), found.where(F.col("kind") == MET).select("sig", "v", "least")
    key = ["n", "fp1", "fp2"]
    classes = written(every.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.first("sketch").alias("sketch")), "classes")
    known = classes.where("class_id IS NOT NULL").withColumnRenamed("fp1", "v")
    members = written(buckets.select("sig", "v").distinct(), "members")
    known = written(known.join(members.select("v").distinct(), "v", "left_semi").select("v", "n", "sketch", "class_id"), "known")

    ids = known.select(F.col("class_id").alias("doc_id"))
    few = known.count() <= BROADCAST_IDS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = written(sets_of(own, words).dropDuplicates(["v"]), "sets")

    seen = written(_first_pairs(buckets, known, percent), "pairs")
    links = _verified(seen, sets, percent)
    labels = components(links)
    for most in ROUNDS:
        part_of = known.join(labels.withColumnRenamed("node", "v"), "v", "left").select("v", "n", "sketch", F.coalesce("component", "v").alias("part"))
        before = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = lambda: _candidates(_open(members, part_of), percent, most).distinct().join(before, ["a", "b"], "left_anti")  # noqa: E731, B023
        pairs = settled(fresh, "pairs")
        more = _verified(pairs, sets, percent)
        seen, links = seen.union(pairs), links.union(more)
        if not more.isEmpty():
            labels = components(links)
    named = classes.join(labels.withColumnRenamed("node", "fp1"), "fp1", "left").select(*key, "class_id", F.coalesce("component", "fp1").alias("part"))
    least = written(named.groupBy("part").agg(F.min("class_id").alias("component_id")), "least")
    named = written(named.join(least, "part").select(*key, "class_id", "component_id"), "named")
    some = every.where("n > 0").select("doc_id", *key).join(named, key).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    none = every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return some.union(none)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without those that have a similar document with a smaller doc_id in their component: one of each group stays.
    Of rows that share the staying doc_id all stay. A row without doc_id stays."""
    gone = link(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")
