"""The personal-data query as DuckDB SQL: the stated patterns, without the possessive repeats of the Spark form."""

from __future__ import annotations

from . import pii

PATTERNS = pii.PATTERNS | {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
}


def sql() -> str:
    found = " UNION ALL ".join(
        f"""SELECT doc_id, row, t, '{k}' AS kind, {pii.KINDS.index(k)} AS rank, {pii.SCORES[k]}::DOUBLE AS score, '{pii.CONTEXT[k]}' AS context,
        regexp_extract_all(t, '{PATTERNS[k]}') AS ms, string_split_regex(t, '{PATTERNS[k]}') AS ps FROM d"""
        for k in pii.KINDS
    )
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    byte = "(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
found AS ({found}),
single AS (
  SELECT doc_id, row, t, kind, rank, score, context, ms, ps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM found WHERE len(ms) > 0
),
started AS (
  SELECT *, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM single
),
placed AS (
  SELECT doc_id, row, kind, rank, m, s, {digits} AS digits,
    score + CASE WHEN regexp_matches(lower(substring(t, greatest(s - {pii.CONTEXT_CHARS}, 0) + 1, least(s, {pii.CONTEXT_CHARS}))), context) THEN {pii.CONTEXT_BONUS}::DOUBLE ELSE 0 END AS score,
    replace(m, ' ', '') AS plain
  FROM started
),
kept AS (
  SELECT *, kind || ':' || s || ':' || (s + length(m)) AS span FROM placed WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(m, '0*{byte}(\.0*{byte}){{3}}')
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)),
      lambda j: CASE WHEN (length(digits) - j) % 2 = 0 THEN digits[j]::INT WHEN digits[j]::INT > 4 THEN 2 * digits[j]::INT - 9 ELSE 2 * digits[j]::INT END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND score >= {pii.LEAST_SCORE} AND list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(plain[5:] || plain[:4], ''),
      lambda x: (CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)::HUGEINT)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
    WHEN 'ssn' THEN score >= {pii.LEAST_SCORE} AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')
    ELSE true END
),
by_row AS (
  SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(pii.BASE)}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans, max(score) AS max_score
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, max_score
FROM d LEFT JOIN by_row USING (row)
"""
