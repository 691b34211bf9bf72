"""Language identification by unigram models of pieces, summed over all segmentations (operator 4).

The pieces are those of a fixed public vocabulary. A language has a probability for every piece; a
word's probability is the sum, over all ways to cut it into pieces, of the products of theirs, by
the forward algorithm. A text's score for a language is the sum of the logarithms over its words;
the prediction is the language with the highest posterior under equal priors. Piece probabilities
come from expectation maximisation (forward and backward) on word counts.

Training takes a bounded sample of the labelled rows: about `SAMPLE_CHARS` characters a language,
chosen by a hash of doc_id and text; of texts of more than `LONG` characters, runs of `RUN` words are chosen
each by itself, so that a language of few and long texts is learned from a part of each. Words are runs of letters in lower case; nothing else is looked at.
Each Python worker keeps the scores of the white-space separated words it has met (`MAX_WORDS`), in arrays by their hashes.

Defined cases: a text that is null, empty or without letters is `und` with score 0; without any
labelled row every text is `und`; ties go to the language first in alphabetical order; repeated
rows are predicted each; an empty table gives no rows; extra columns are kept by `predict`
(columns named as its results are replaced).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .words import Memory, Words, mix, release

UNKNOWN = "und"
SAMPLE_CHARS, ROUNDS, SMOOTHING = 2_000_000, 3, 0.01
LONG, RUN = 20_000, 500
MAX_WORDS = 700_000
#: A document that is kept has at least this score.
LEAST_SCORE = 0.5
#: Runs of letters; number signs such as ½ aren't letters.
_LETTERS = regex.compile(r"\p{L}+")
_START = "▁"


def vocabulary(path: str | None = None) -> list[str]:
    """The pieces that can stand in a word: letters in lower case, with or without the sign of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or tokens.tokenizer_path("piece_bpe_32k.model"))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in found if _LETTERS.fullmatch(p.removeprefix(_START) or "a") and p == p.lower()} | {_START})


class Pieces:
    """Finds every piece of the vocabulary, and every single sign, in words: by hashes of the pieces' beginnings, all places of
    all words at once, a sign further each step."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.tables = pieces, []
        longest = max(map(len, pieces), default=1)
        self.factors = mix(np.arange(longest).astype(np.uint64), 0x91EC) | np.uint64(1)
        for n in range(1, longest + 1):
            own = {p[:n]: -1 for p in pieces if len(p) >= n} | {p: i for i, p in enumerate(pieces) if len(p) == n}
            h = (_signs("".join(own)).reshape(-1, n) * self.factors[:n]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], np.fromiter(own.values(), np.int64, len(own))[order]))

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of all arcs in order of end, and the words' lengths; piece -1: a sign outside the vocabulary."""
        marked = [_START + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        signs = _signs("".join(marked))
        last = np.repeat(np.cumsum(lengths), lengths)
        at, h, found = np.arange(len(signs)), np.zeros(len(signs), np.uint64), []
        for n, (keys, pieces) in enumerate(self.tables, 1):
            some = at + n <= last[at]
            at, h = at[some], h[some]
            h = h + signs[at + n - 1] * self.factors[n - 1]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[place] == h
            piece = np.where(known, pieces[place], -1)
            hit = piece >= 0 if n > 1 else np.ones(len(at), bool)
            found.append((at[hit], np.full(int(hit.sum()), n), piece[hit]))
            at, h = at[known], h[known]
        start, size, piece = (np.concatenate(x) for x in zip(*found))
        word = np.repeat(np.arange(len(words)), lengths)[start]
        start = start - (np.cumsum(lengths) - lengths)[word]
        order = np.argsort(start + size, kind="stable")
        return word[order], start[order], (start + size)[order], piece[order], lengths


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def forward(arcs: tuple, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all segmentations. p: (pieces + 1, languages), the last row for signs outside the vocabulary. Returns the
    words' log probabilities, and the scaled sums and log scales at each place (for the backward pass)."""
    word, start, end, piece, lengths = arcs
    base = np.cumsum(lengths + 1) - lengths - 1
    a = np.zeros((int((lengths + 1).sum()), p.shape[1]))
    scale = np.zeros(len(a))
    a[base] = 1
    edges = np.searchsorted(end, np.arange(1, int(lengths.max(initial=0)) + 2))
    for lo, hi in zip(edges[:-1], edges[1:]):
        w, to = word[lo:hi], base[word[lo:hi]] + end[lo:hi]
        from_ = base[w] + start[lo:hi]
        order = np.argsort(to, kind="stable")
        to, from_ = to[order], from_[order]
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        at = to[heads]
        scale[at] = scale[at - 1]  # a sign further; the sums are kept near one
        value = a[from_] * p[piece[lo:hi][order]] * np.exp(scale[from_] - scale[to])[:, None]
        sums = np.add.reduceat(value, heads, axis=0)
        top = np.maximum(sums.max(axis=1), 1e-300)
        a[at] = sums / top[:, None]
        scale[at] += np.log(top)
    last = base + lengths
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(a[last], 1e-300)) + scale[last][:, None], a, scale


def expected(arcs: tuple, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (rows as in p) in one language's words, each counted counts[word] times; p has one column."""
    word, start, end, piece, lengths = arcs
    _, a, scale = forward(arcs, p)
    base = np.cumsum(lengths + 1) - lengths - 1
    b = np.zeros(len(a))
    last = base + lengths
    b[last] = 1
    total = a[last, 0]
    uses = np.zeros(len(p))
    for t in range(int(lengths.max(initial=0)), 0, -1):
        lo, hi = np.searchsorted(end, [t, t + 1])
        w = word[lo:hi]
        to, from_ = base[w] + t, base[w] + start[lo:hi]
        # b at `to` is complete: all arcs that leave it end later
        value = b[to] * p[piece[lo:hi], 0] * np.exp(scale[from_] - scale[to])
        np.add.at(b, from_, value)
        np.add.at(uses, piece[lo:hi], counts[w] * a[from_, 0] * value / np.maximum(total[w], 1e-300))
    return uses


class Model:
    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.pieces, self.p, self.key = languages, pieces, p, uuid.uuid4().hex


def fit(words: dict[str, dict[str, int]], pieces: list[str] | None = None, rounds: int = ROUNDS) -> Model:
    """Piece probabilities for each language, from the counts of its words."""
    pieces = pieces or vocabulary()
    finder, languages, columns = Pieces(pieces), sorted(words), []
    for lang in languages:
        own = sorted(words[lang])
        counts = np.array([words[lang][w] for w in own], float)
        parts = [(finder.arcs(own[k : k + 20_000]), counts[k : k + 20_000]) for k in range(0, len(own), 20_000)]
        p = np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1))
        for _ in range(rounds):
            uses = sum((expected(arcs, p, c) for arcs, c in parts), np.zeros(len(p))) + SMOOTHING
            p = (uses / uses.sum())[:, None]
        columns.append(p[:, 0])
    p = np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0))
    if columns:
        p[-1] = p[-1].min()  # what no vocabulary knows tells nothing
    return Model(languages, pieces, p)


class Scorer:
    """One worker's memory of words: a row for each, with log probabilities and the number of letters."""

    def __init__(self, model: Model):
        self.model, self.finder, self.known = model, Pieces(model.pieces), Memory()
        self.rows = np.zeros((1 << 16, len(model.languages) + 1), np.float32)

    def _learn(self, new: list[str], key: np.ndarray, check: np.ndarray) -> np.ndarray:
        runs = [_LETTERS.findall(w.lower()) for w in new]
        flat = list({r for rs in runs for r in rs})
        logs = np.zeros((len(flat), len(self.model.languages)))
        order = sorted(range(len(flat)), key=lambda i: len(flat[i]))
        k = 0
        while k < len(order) and self.model.languages:
            n = max(1, min(5_000, 2_000_000 // (len(flat[order[k]]) + 8)))
            while n > 1 and len(flat[order[min(k + n, len(order)) - 1]]) * n > 4_000_000:
                n //= 2
            at = order[k : k + n]
            logs[at] = forward(self.finder.arcs([flat[i] for i in at]), self.model.p)[0]
            k += n
        number = {r: i for i, r in enumerate(flat)}
        first = len(self.known)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        index = np.array([number[r] for rs in runs for r in rs], np.int64)
        owner = np.repeat(np.arange(len(new)), [len(rs) for rs in runs])
        sums = np.zeros((len(new), logs.shape[1] + 1))
        if len(index):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            values = np.concatenate([logs[index], np.array([len(flat[i]) for i in index], float)[:, None]], axis=1)
            sums[owner[heads]] = np.add.reduceat(values, heads, axis=0)
        self.rows[first : first + len(new)] = sums
        rows = np.arange(first, first + len(new))
        self.known.add(key, check, rows)
        return rows

    def sums(self, texts: pa.Array) -> np.ndarray:
        """For each text the sum of its words' rows."""
        words = Words(texts, keys=2)
        key, first, inverse = np.unique(words.keys[0], return_index=True, return_inverse=True)
        check = words.keys[1][first]
        rows = self.known.find(key, check)
        new = np.flatnonzero(rows < 0)
        if len(new):
            if len(self.known) and len(self.known) + len(new) > MAX_WORDS:
                self.known, new = Memory(), np.arange(len(key))
            rows[new] = self._learn(words.strings(first[new]), key[new], check[new])
        index, edges = rows[inverse], np.concatenate([[0], np.cumsum(words.counts)])
        out = np.zeros((len(texts), self.rows.shape[1]))
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            out[full] = np.add.reduceat(self.rows[index].astype(np.float64), edges[full], axis=0)
        return out


def scorer(model: Model) -> Scorer:
    return tokens.held(("scorer", model.key), lambda: Scorer(model))


def train(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on `labelled` (doc_id, text, lang); rows without text or lang are left out. A row for each language, and the
    sample's word counts, come to the driver."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] or 0 for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}
    share = {k: min(1.0, sample_chars / max(1, n)) for k, n in sizes.items()}
    shares = rows.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    picked = lambda *of: F.pmod(F.xxhash64("doc_id", "text", *of), F.lit(1_000_000)) < F.col("share") * 1_000_000
    every = F.split(F.lower("text"), r"[^\p{L}]+")
    runs = F.transform(F.sequence(F.lit(0), (F.size("every") - 1).cast("int"), F.lit(RUN)), lambda i: F.struct(i.alias("i"), F.slice("every", i + 1, F.lit(RUN)).alias("ws")))
    weighed = rows.join(F.broadcast(shares), "lang")
    short = weighed.where((F.length("text") <= LONG) & picked()).select("lang", every.alias("ws"))
    long = weighed.where(F.length("text") > LONG).withColumn("every", every).select("lang", "doc_id", F.xxhash64("text").alias("text"), "share", F.explode(runs).alias("run"))
    chosen = short.union(long.where(picked("run.i")).select("lang", "run.ws"))
    words = chosen.select("lang", F.explode("ws").alias("word")).where("word <> ''").groupBy("lang", "word").count()
    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}
    table = words.toArrow()
    for lang, word, n in zip(*(table[c].to_pylist() for c in ("lang", "word", "count"))):
        for w in _LETTERS.findall(word):
            counts[lang][w] = counts[lang].get(w, 0) + n
    return fit(counts)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its score, called `names`; from the text alone."""
    kept = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        own = scorer(model)
        languages = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for first, texts in tokens.chunks(batch.column(at)):
                sums = own.sums(texts)
                logs, letters = sums[:, :-1], sums[:, -1]
                best, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
                if model.languages:
                    some = letters > 0
                    top = logs.max(axis=1)
                    posterior = 1 / np.exp(logs - top[:, None]).sum(axis=1)
                    best[some], score[some] = logs.argmax(axis=1)[some], posterior[some]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages[best], pa.string()), pa.array(score)], names=[*part.schema.names, "lang", "score"])
            release()

    # under names of our own, as those of docs may need quotes
    plain = docs.select(*(F.col(f"`{c}`").cast("string" if c == text else docs.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(kept)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{schema}, lang string, score double").toDF(*kept, *names)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """The fold that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the labelled rows of `docs` (doc_id, text, lang) outside the held-out fold and predicts every row:
    doc_id, held_out, lang_pred, score."""
    model = train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    return predict(docs.select(F.col("doc_id"), held_out().alias("held_out"), "text"), model).drop("text")
