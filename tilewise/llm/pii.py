"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (operator 8).

DataFrame functions only. Each kind has a pattern; the text between the matches (`split`) and the
matches (`regexp_extract_all`) together give the matches' places in code points. The patterns are
the stated ones with possessive repeats, and start only where a run starts or the last match
ended, so that they take time in proportion to the text; they find the same matches.

A span's score is its kind's own score, and `CONTEXT_BONUS` more if one of the kind's context words
stands within `CONTEXT_CHARS` characters before it. Kinds beyond the base ones keep only spans of at
least `LEAST_SCORE`; base spans always stay.

Defined cases: null text is an empty text; an empty text has no spans and the digest of an empty
string; an empty table gives no rows; repeated rows are kept, each with its spans; extra columns
stay as they are (columns named as the results are replaced).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?={_LOCAL})(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A text without this can't have a match.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT = {
    "email": "e-?mail|contact|write",
    "ip": "address|server|host",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "social security|ssn|taxpayer",
}
CONTEXT_CHARS, CONTEXT_BONUS, LEAST_SCORE = 40, 0.1, 0.5
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

_BYTE = "(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((F.length(digits) - i) % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN's check digits are right: its letters as numbers 10 to 35, its first four signs behind the rest."""
    plain = F.regexp_replace(match, "\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(total: Column, sign: Column) -> Column:
        value = F.when(sign.between("0", "9"), F.ascii(sign) - 48).otherwise(F.ascii(sign) - 55)
        return (total * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1))), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^0*{_BYTE}(?:\.0*{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, "\x20", "")).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, also where `use` needs it for every element of a list."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(lengths: Column) -> Column:
    """For each length the sum of those before it, by blocks: a long list doesn't take time with its square."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def with_lengths(xs: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.size(xs) - 1)), lambda b: total(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))

        def with_sums(ts: Column) -> Column:
            def with_bases(bs: Column) -> Column:
                return F.transform(xs, lambda _, i: F.get(bs, block(i)) + total(F.slice(xs, block(i) * _BLOCK + 1, i % _BLOCK)))

            return _let(F.transform(ts, lambda _, i: total(F.slice(ts, F.lit(1), i))), with_bases)

        return _let(sums, with_sums)

    return _let(lengths, with_lengths)


def _matches(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    return F.when(F.instr(text, NEEDS[kind]) > 0, found) if kind in NEEDS else found


def _ahead(pieces: Column, matches: Column, i: Column) -> Column:
    """The CONTEXT_CHARS signs before match i, from the pieces and matches before it. A match has two signs at least."""
    first = F.greatest(i - CONTEXT_CHARS // 2, F.lit(0))
    tail = lambda x: F.right(x, F.lit(CONTEXT_CHARS))
    parts = F.transform(F.sequence(first, i), lambda j: F.concat(tail(F.get(pieces, j)), F.when(j < i, tail(F.get(matches, j))).otherwise("")))
    return tail(F.array_join(parts, ""))


def with_spans(docs: DataFrame, kinds: tuple[str, ...] = KINDS, text: str = "text") -> DataFrame:
    """`docs` with `pii`: all confirmed spans in order of start, then of kind: struct(start, rank, end, kind, score)."""
    columns = [f"`{c}`" for c in docs.columns if c != "pii"]
    df = docs.withColumn("__pii_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.select(*columns, "__pii_t", *(_matches(k, F.col("__pii_t")).alias(f"__pii_m_{k}") for k in kinds))
    some = lambda k, x: F.when(F.size(F.coalesce(F.col(f"__pii_m_{k}"), F.array().cast("array<string>"))) > 0, x)
    # most texts have no match: the rest is worked out where there is one
    df = df.select(*columns, *(f"__pii_m_{k}" for k in kinds), *(some(k, F.split(F.col("__pii_t"), PATTERNS[k], -1)).alias(f"__pii_p_{k}") for k in kinds))
    df = df.select("*", *(F.when(F.col(f"__pii_p_{k}").isNotNull(), _before(F.zip_with(F.slice(f"__pii_p_{k}", 1, F.size(f"__pii_m_{k}")), f"__pii_m_{k}", lambda p, m: F.length(p) + F.length(m)))).alias(f"__pii_b_{k}") for k in kinds))

    def spans(k: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            piece = F.get(F.col(f"__pii_p_{k}"), i)
            start = F.get(F.col(f"__pii_b_{k}"), i) + F.length(piece)
            near = F.lower(_ahead(F.col(f"__pii_p_{k}"), F.col(f"__pii_m_{k}"), i)).rlike(CONTEXT[k])
            score = F.lit(SCORES[k]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
            return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(k)).alias("rank"), (start + F.length(m)).cast("long").alias("end"), F.lit(k).alias("kind"), score.alias("score"), confirmed(k, m).alias("ok"))

        found = F.transform(F.col(f"__pii_m_{k}"), one)
        kept = F.filter(found, lambda s: s["ok"] if k in BASE else s["ok"] & (s["score"] >= LEAST_SCORE))
        return F.when(F.col(f"__pii_p_{k}").isNotNull(), kept).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,score:double,ok:boolean>>"))

    every = F.array_sort(F.concat(*map(spans, kinds)))
    return df.select(*columns, every.alias("pii"))


def digest(found: DataFrame) -> DataFrame:
    """From `with_spans`: doc_id, counts of the base kinds, and all spans as text."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    own = lambda k: F.filter("pii", lambda s: s["kind"] == k)
    return found.select(
        "doc_id", *(F.size(own(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, kinds: tuple[str, ...] = ("email", "iban", "card", "phone", "ip", "ssn"), text: str = "text") -> DataFrame:
    """`docs` with each confirmed span's text replaced by its kind's mask, kind after kind. A null text stays null."""
    def masked(df: DataFrame, k: str) -> DataFrame:
        t, m = F.col(text), F.col("__pii_m")
        df = df.withColumn("__pii_m", _matches(k, t))
        df = df.withColumn("__pii_p", F.when(F.size(F.coalesce(m, F.array().cast("array<string>"))) > 0, F.split(t, PATTERNS[k], -1)))

        def cover(p: Column, i: Column) -> Column:
            own = F.get(m, i)
            near = F.lower(_ahead(F.col("__pii_p"), m, i)).rlike(CONTEXT[k]) if SCORES[k] < LEAST_SCORE else F.lit(True)
            return F.concat(p, F.coalesce(F.when(own.isNotNull() & confirmed(k, own) & near, MASKS[k]).otherwise(own), F.lit("")))

        return df.withColumn(text, F.when(F.col("__pii_p").isNotNull(), F.array_join(F.transform("__pii_p", cover), "")).otherwise(t))

    return reduce(masked, kinds, docs).select(*(f"`{c}`" for c in docs.columns))


def redact_documents(docs: DataFrame) -> DataFrame:
    """As `redact`; a column n_chars, where there is one, follows the text."""
    done = redact(docs)
    if "n_chars" not in docs.columns:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
