"""DuckDB SQL for the queries that SQL can express, made from the operators'
own rules and templates but from none of their Spark code."""

from __future__ import annotations

from tombolo.llm import license_scan, secret_scan

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _ascii_cases(pattern: str) -> str:
    """The pattern with the words of its first group spelled in both cases, as DuckDB's ``(?i)`` goes beyond ASCII."""
    if not pattern.startswith("(?i)"):
        return pattern
    head, _, tail = pattern.removeprefix("(?i)").partition(")")
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail


def op1() -> str:
    """Places are sums over the texts between matches, as DuckDB gives no offsets."""
    parts = []
    for rank, r in enumerate(secret_scan.RULES):
        p = _text(_ascii_cases(r.pattern))
        parts.append(
            f"""SELECT doc_id, text, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least,
            regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {r.group}) AS cores, string_split_regex(text, {p}) AS gaps FROM d"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, rank, kind, length(hits[i]) AS n,
        list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
      FROM e WHERE length(cores[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) FILTER (rank < {len(secret_scan.BASE_RULES)}) AS base,
        string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(d.text) AS blob
FROM d LEFT JOIN g USING (doc_id)"""


def op6() -> str:
    """Votes of word grams for templates, merged and verified as the operator defines them, on strings in place of hashes."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    phrases = " UNION ALL ".join(f"SELECT {_text(label)} AS label, string_split({_text(phrase)}, ' ') AS p" for phrase, label in license_scan.PHRASES)
    templates = " UNION ALL ".join(f"SELECT {i} AS template, {_text(label)} AS label, string_split({_text(body)}, ' ') AS t" for i, (label, body) in enumerate(license_scan.TEMPLATES))
    k, near, least = license_scan.K, license_scan.NEAR, license_scan.LEAST
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({lower}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
ph AS ({phrases}),
b AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS place
      FROM d JOIN ph ON list_has_all(w, p)),
bs AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM b GROUP BY doc_id),
t AS ({templates}),
tg AS (SELECT template, label, len(t) - {k - 1} AS n_grams, q, array_to_string(t[q + 1:q + {k}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(t) - {k - 1})) AS q FROM t)),
dg AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {k}], ' ') AS gram FROM (SELECT *, unnest(range(0, len(w) - {k - 1})) AS pos FROM d)),
h AS (SELECT doc_id, template, label, n_grams, pos, q, pos - q AS diagonal FROM dg JOIN tg USING (gram)),
g AS (SELECT DISTINCT doc_id, template, diagonal FROM h),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {near} THEN 0 ELSE 1 END AS fresh FROM g),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM n),
l AS (SELECT doc_id, template, label, n_grams, span, list(q ORDER BY pos, q) AS places
      FROM h JOIN m USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, n_grams, span),
v AS (SELECT doc_id, label, n_grams, list_reduce(list_transform(places, lambda p: {{'q': p::BIGINT, 'n': 1::BIGINT}}),
        lambda a, p: CASE WHEN p.q > a.q THEN {{'q': p.q, 'n': a.n + 1}} ELSE a END).n / n_grams AS score FROM l),
s AS (SELECT doc_id, list(DISTINCT label) AS more, max(score) AS best FROM v WHERE score >= {least} GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN s USING (doc_id)"""


def op4() -> str:
    """All pairs of queries and candidates."""
    return """
WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM f),
q AS (SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM f WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
