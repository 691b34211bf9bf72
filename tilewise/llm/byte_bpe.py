"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse (operator 13).

**Encoding.** A merge list is proper if each rule's parts are bytes or results of earlier rules, and if no two rules give one
string. Then a sequence of tokens is the encoding of its text if each token is the encoding of its own string and each two
neighbours are that of theirs: rules only ever merge over the seam of two tokens by what stands on both sides of it. Whether a
seam holds follows from the two tokens' own histories: the tokens that stand at the seam while the rules are gone through.
So the encoding of each prefix of a text is known from its last token: the one token that ends there and holds with the
last token of what precedes it. The transducer finds all tokens that end at a byte by an Aho-Corasick automaton, whose state
carries over from block to block, and keeps the last token of the bytes that aren't settled.

**Lookahead.** What follows a text can change its encoding only from right to left: a rule applied (or not) where the text goes
on lets a later rule, whose span overlaps, be not applied (or be). Spans shorter than the longest token, in the order of
the rules: `lookahead` finds by one pass over the merge list the farthest such a chain can reach. Tokens that end farther than
that from the end of what has been read are stable. Most are so much sooner: all encodings of the last few bytes' prefixes
share them. The transducer settles what all share, and raises if more than the lookahead is ever left: its memory is bounded by
the merge list and not by the text.

**Pieces.** The vocabulary's pattern cuts texts into pieces before; `Pieces` does so block by block. A piece that
goes on at the end of a block (a million letters without a space, say) is handed on in parts. Pieces that are whole
go through the same transducer; a worker remembers at most `MOST_PIECES` of their results.

**Decoding.** Ids become bytes block by block, bytes become text by an incremental UTF-8 automaton that holds an open
character; broken sequences become U+FFFD as in the library.

Defined cases: null text counts as empty; the text of a special token gives its id, as the library does; repeated rows are
repeated; ids without a token are left out in decoding; an empty table gives no rows; extra columns are ignored. Truncation and padding are off.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .words import release

#: Characters of a text that are read at a time.
BLOCK = 1 << 16
#: Pieces that a worker remembers, of this many characters at most; then it starts anew.
MOST_PIECES, LONGEST_PIECE = 300_000, 40
#: A piece of so many characters is handed on in parts.
OPEN = 4096
#: Bytes after which the transducer settles what is stable.
SETTLE = 1024
#: Code points below are in the same classes in all versions of Unicode that libraries have.
_OLD = 0x530


def byte_signs() -> dict[str, int]:
    """The public byte-level alphabet: visible Latin-1 signs stand for themselves, the other bytes for code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A merge list and its tokens, numbered so that bytes come first and results of rules follow in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        sign = byte_signs()
        spelled = lambda token: bytes(sign[c] for c in token)
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        ids = {spelled(t): n for t, n in given["model"]["vocab"].items() if t not in self.special}
        rules = [tuple(map(spelled, m if isinstance(m, list) else m.split(" "))) for m in given["model"]["merges"]]
        self.strings = [bytes([b]) for b in range(256)]
        number = {s: k for k, s in enumerate(self.strings)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rule: dict[tuple[int, int], int] = {}
        for a, b in rules:
            if a not in number or b not in number or a + b in number:
                raise ValueError("the merge list isn't proper: the transducer can't stand for it")
            number[a + b] = len(self.strings)
            self.rule[number[a], number[b]] = len(self.strings)
            self.parts.append((number[a], number[b]))
            self.strings.append(a + b)
        if missing := [s for s in self.strings if s not in ids]:
            raise ValueError(f"{len(missing)} tokens have no id")
        self.ids = np.array([ids[s] for s in self.strings], np.uint32)
        self.longest = max(map(len, self.strings))
        # what stands at a token's left and right edge while the rules are gone through, with the rule that ends it
        self.left: list[tuple] = []
        self.right: list[tuple] = []
        never = 1 << 60
        for t, parts in enumerate(self.parts):
            for edge, side in ((self.left, 0), (self.right, 1)):
                before = () if parts is None else tuple((x, until if until < never else t) for x, until in edge[parts[side]])
                edge.append((*before, (t, never)))
        self.seams: dict[int, bool] = {}
        self.whole = np.array([parts is None or self._holds(*parts, t) for t, parts in enumerate(self.parts)])
        for t, parts in enumerate(self.parts):  # of parts that stand for themselves
            if parts is not None:
                self.whole[t] &= self.whole[parts[0]] and self.whole[parts[1]]

    def _holds(self, a: int, b: int, before: int) -> bool:
        """Whether no rule before `before` merges over the seam of two tokens."""
        rule, right, left = self.rule, self.right[a], self.left[b]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            found = rule.get((x, y), before)
            # of a rule that could also take the left one's neighbour before it, that one comes first
            if found < before and found < x_until and found <= y_until:
                return False
            if min(x_until, y_until) >= before:
                return True
            if x_until <= y_until:
                i += 1
            if y_until <= x_until:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        key = a << 32 | b
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > 1_000_000:
                self.seams.clear()
            known = self.seams[key] = self._holds(a, b, 1 << 59)
        return known

    def lookahead(self) -> int:
        """Bytes after which the encoding of a text's beginning no longer depends on what follows.

        Two texts that begin alike are encoded alike up to the first rule that is applied in one only: its span reaches the place
        where they part, so it begins less than `longest` before. Each later rule of which that can be said overlaps the span of an earlier
        one and begins `o` bytes before it; what it has from there on and the earlier one's string agree, one being the other's
        beginning. reach: how far before the parting place a chain of such rules can begin, by the rule that ends it."""
        begins: dict[bytes, int] = {}  # a beginning of rules' strings -> the farthest reach of those that have it
        itself: dict[bytes, int] = {}
        most = 0
        for s in self.strings[256:]:
            n, reach = len(s), len(s) - 1
            for o in range(1, n):
                far = begins.get(s[o:], -1)
                for e in range(o + 2, n):
                    far = max(far, itself.get(s[o:e], -1))
                if far >= 0:
                    reach = max(reach, o + far)
            itself[s] = reach
            for e in range(1, n + 1):
                if begins.get(s[:e], -1) < reach:
                    begins[s[:e]] = reach
            most = max(most, reach)
        return most + self.longest


class Transducer:
    """Bytes in, tokens out as soon as they are stable. One for each piece of text."""

    def __init__(self, codec: Codec):
        self.codec, self.merges = codec, codec.merges
        self.base, self.end = 0, 0  # settled up to base, read up to end
        self.last: dict[int, int] = {0: -1}  # at each place since base: the last token of the encoding up to there
        self.search = None

    def _read(self, data: bytes) -> None:
        last, sizes, fits, seams = self.last, self.codec.sizes, self.merges.fits, self.merges.seams
        if self.search is None:
            self.search = self.codec.automaton.iter(data.decode("latin-1"))
        else:
            self.search.set(data.decode("latin-1"))  # goes on from the state and place where it was
        for at, t in self.search:
            if at + 1 not in last:
                before = last.get(at + 1 - sizes[t], -2)
                if before == -1 or before >= 0 and (fits(before, t) if (known := seams.get(before << 32 | t)) is None else known):
                    last[at + 1] = t
        self.end += len(data)

    def feed(self, data: bytes) -> list[int]:
        """The tokens that have become stable, in order."""
        out = []
        for k in range(0, len(data), SETTLE):
            self._read(data[k : k + SETTLE])
            if self.end - self.base > SETTLE:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """What all encodings share that end within the last token's length, one of which what follows goes on from."""
        sizes, last = self.codec.sizes, self.last
        heads = set(range(max(self.base, self.end - self.merges.longest + 1), self.end + 1))
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(far - sizes[last[far]])
        (shared,) = heads
        if self.end - shared > self.codec.lookahead + self.merges.longest:
            raise RuntimeError("tokens aren't stable within the lookahead")
        return self._out(shared)

    def _out(self, to: int) -> list[int]:
        sizes, last, out, at = self.codec.sizes, self.last, [], to
        while at > self.base:
            out.append(last[at])
            at -= sizes[last[at]]
        if to > self.base:
            self.last = {p: t for p, t in last.items() if p > to}
            self.last[to] = last[to]  # the seam with what follows is still to be looked at
            self.base = to
        return out[::-1]

    def finish(self) -> list[int]:
        return self._out(self.end)


class Pieces:
    """Text in, block by block; its pieces by the vocabulary's pattern out."""

    def __init__(self, codec: Codec):
        self.codec, self.rest, self.kind = codec, "", None

    def feed(self, text: str) -> Iterator[tuple[str | list[str], bool]]:
        """Lists of whole pieces, parts of a piece that is open (True), and the end of one ("", False)."""
        codec = self.codec
        codec.learn_classes(text)
        text = self.rest + text
        if self.kind:
            text = yield from self._go_on(text)
            if self.kind:
                return
        whole, held = codec.pattern.findall(text), 0
        while whole and held < 3:  # what follows may still change it
            held += len(whole.pop())
        if whole:
            yield whole, False
        self.rest = text[len(text) - held :]
        if held > OPEN:
            first = codec.pattern.match(self.rest).end()
            if first < held:  # a long piece, but whole
                yield self.rest[:first], True
                yield "", False
                self.rest = self.rest[first:]
            else:  # its first character may be the space before a run
                yield self.rest[0], True
                self.kind = next(k for k in codec.runs if codec.runs[k].match(self.rest[1]))
                yield from self._go_on(self.rest[1:])

    def _go_on(self, text: str):
        """Hands on the part of `text` that belongs to the open piece; returns the rest."""
        m = self.codec.runs[self.kind].match(text)
        end = m.end() if m else 0
        if end < len(text):  # the run ends; its last space goes to what follows
            end = end - 1 if self.kind == "space" else end
            if end > 0:
                yield text[:end], True
            yield "", False
            self.kind = None
            return text[max(end, 0) :]
        held = 1 if self.kind == "space" else 0
        if end > held:
            yield text[: end - held], True
        self.rest = text[end - held :]
        return self.rest

    def finish(self) -> Iterator[tuple[str | list[str], bool]]:
        if self.kind:
            if self.rest:
                yield self.rest, True
            yield "", False
        else:
            whole = self.codec.pattern.findall(self.rest)
            if whole:
                yield whole, False
        self.rest, self.kind = "", None


class Remembered(dict):
    """Packed ids of pieces: asked for a new one, it encodes it. Long ones aren't kept, and it starts anew where it holds too many."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encoded(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """A worker's transducer, memory of pieces, and decoder for one vocabulary file."""

    def __init__(self, path: str, lookahead: int | None = None):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        self.regex, self.merges = regex, Merges(path)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.lookahead = self.merges.lookahead() if lookahead is None else lookahead
        self.sizes = [len(s) for s in self.merges.strings]
        self.automaton = ahocorasick.Automaton()
        for t, s in enumerate(self.merges.strings):
            if self.merges.whole[t]:
                self.automaton.add_word(s.decode("latin-1"), t)
        self.automaton.make_automaton()
        self.packed = [int(i).to_bytes(4, "little") for i in self.merges.ids]
        self.known = Remembered(self)
        self.classes: set[str] = set()
        self.odd: set[str] = set()
        self._compile()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True)))) if self.merges.special else None
        # the decoder's strings by id, one after another
        by_id = dict(zip(self.merges.ids.tolist(), self.merges.strings)) | {i: s.encode() for s, i in self.merges.special.items()}
        size = max(by_id) + 1
        strings = [by_id.get(i, b"") for i in range(size)]
        self.pool = np.frombuffer(b"".join(strings), np.uint8)
        self.counts = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def _compile(self) -> None:
        """The public pattern of this kind of vocabulary, but letters and numbers that the library doesn't know are other signs."""
        out = "".join(map(self.regex.escape, sorted(self.odd)))
        letter, number = (rf"[\p{{{c}}}--[{out}]]" if out else rf"\p{{{c}}}" for c in "LN")
        other = rf"[[^\s\p{{L}}\p{{N}}]||[{out}]]" if out else r"[^\s\p{L}\p{N}]"
        self.pattern = self.regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+", self.regex.V1)
        self.runs = {k: self.regex.compile(f"{c}+", self.regex.V1) for k, c in (("space", r"\s"), ("letter", letter), ("number", number), ("other", other))}
        self.old = self.regex.compile(f"[^\\x00-{chr(_OLD - 1)}]")

    def learn_classes(self, text: str) -> None:
        """Asks the library once for each newer code point whether it takes it for what our pattern does."""
        if text.isascii():
            return
        new = set(self.old.findall(text)) - self.classes
        if not new:
            return
        odd = {c for c in new if len(self.library.pre_tokenize_str(f"!{c}")) == 1 and self.regex.match(r"[\p{L}\p{N}]", c)}
        self.classes |= new
        if odd:
            self.odd |= odd
            self._compile()

    def encoded(self, piece: str) -> bytes:
        """The packed ids of a whole piece: what a transducer does that is fed all of it and finished, with a list for its window."""
        data, sizes, seams, fits, last, done = piece.encode().decode("latin-1"), self.sizes, self.merges.seams, self.merges.fits, [-1], -1
        for at, t in self.automaton.iter(data):
            if at != done:
                before = last[at + 1 - sizes[t]]
                if before < 0 or (fits(before, t) if (known := seams.get(before << 32 | t)) is None else known):
                    last.append(t)
                    done = at
        out, at = [], len(data)
        while at:
            out.append(self.packed[last[at]])
            at -= sizes[last[at]]
        return b"".join(out[::-1])

    def _segment(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of a text without special tokens."""
        cut, run = Pieces(self), None

        def ids(found: Iterator) -> Iterator[bytes]:
            nonlocal run
            for text, open_ in found:
                if isinstance(text, list):
                    yield b"".join(map(self.known.__getitem__, text))
                else:
                    run = run or Transducer(self)
                    got = run.feed(text.encode()) if open_ else run.finish()
                    if not open_:
                        run = None
                    yield b"".join(map(self.packed.__getitem__, got))

        for block in blocks:
            yield from ids(cut.feed(block))
        yield from ids(cut.finish())

    def encode(self, text: str, block: int = BLOCK) -> Iterator[bytes]:
        """Ids of a text as little-endian unsigned 32-bit integers, block by block."""
        at = 0
        while True:
            m = self.special.search(text, at) if self.special else None
            end = m.start() if m else len(text)
            if end > at:
                yield from self._segment(text[k : min(k + block, end)] for k in range(at, end, block))
            if m is None:
                return
            yield self.merges.special[m.group()].to_bytes(4, "little")
            at = m.end()

    def decode(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """The text of blocks of ids, block by block."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            ids = ids[ids < len(self.counts)]
            sizes = self.counts[ids]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
            yield machine.decode(self.pool[at].tobytes())
        yield machine.decode(b"", True)


def vocabulary(path: str | None = None) -> str:
    return path or tokens.tokenizer_path("byte_bpe_50k.json")


@functools.lru_cache(4)
def lookahead_of(path: str) -> int:
    return Merges(path).lookahead()


def codec(path: str, lookahead: int) -> Codec:
    return tokens.held(("byte_bpe", path), lambda: Codec(path, lookahead))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of `docs` (doc_id, text)."""
    path = vocabulary(path)
    lookahead = lookahead_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, lookahead)
        for batch in batches:
            for first, texts in tokens.chunks(batch.column(1)):
                ids = [b"".join(own.encode(t)) for t in texts.to_pylist()]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of `encoded` (doc_id, ids); null ids give null."""
    path = vocabulary(path)
    lookahead = lookahead_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, lookahead)
        for batch in batches:
            texts = []
            for one in batch.column(1):
                ids = None if not one.is_valid else one.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                texts.append(None if ids is None else "".join(own.decode(ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each row of `docs` encoded and decoded again, block by block: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary(path)
    lookahead = lookahead_of(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, lookahead)
        for batch in batches:
            for first, texts in tokens.chunks(batch.column(1)):
                counts, sums, back = [], [], []
                for text in texts:
                    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0

                    def seen(blocks: Iterator[bytes]) -> Iterator[np.ndarray]:
                        nonlocal n
                        for packed in blocks:
                            ids.update(packed)
                            n += len(packed) // 4
                            yield np.frombuffer(packed, "<u4")

                    for part in own.decode(seen(own.encode(text.as_py()))):
                        decoded.update(part.encode())
                    counts.append(n)
                    sums.append(ids.hexdigest())
                    back.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
