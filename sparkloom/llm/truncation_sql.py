"""SQL that must give the rows of p9_limits, p9_found and p9_sources."""

from __future__ import annotations

from sparkloom.llm.truncation import _BLANKS, _CLOSERS, _USUAL, _USUAL_DOTS, FALSE_DISCOVERIES, GUARD, REACH

_SET = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _BLANKS) + "]"
_TEXTS = f"d AS (SELECT doc_id, source, text, regexp_replace(text, '{_SET}+$', '') AS whole FROM documents)"


def _up_to(k: int, offset: int) -> str:
    """Endings, and lengths of the texts that ended, up to this length + offset."""
    frame = f"RANGE BETWEEN UNBOUNDED PRECEDING AND {abs(offset)} {'FOLLOWING' if offset > 0 else 'PRECEDING'}"
    over = f"OVER (PARTITION BY unit, source ORDER BY len {frame})"
    return f"coalesce(sum(n) {over}, 0) AS e{k}, coalesce(sum(n * (len + 1)) {over}, 0) AS c{k}, greatest(len + {offset + 1}, 0) AS s{k}"


_OFFSETS = (-REACH - 1, -GUARD - 1, GUARD, REACH)
_RISK = "({c}{k} + s{k} * (total - e{k}))"
_EXPOSED = " ".join(f"{sign} {_RISK.format(c='c', k=k)}" for k, sign in enumerate("-+-+"))
_LIMITS = f"""{_TEXTS}, u AS (SELECT 'chars' AS unit, source, length(text) AS len FROM d WHERE whole <> '' UNION ALL SELECT 'bytes', source, strlen(text) FROM d WHERE whole <> ''),
 c AS (SELECT unit, source, len, count(*) AS n FROM u GROUP BY ALL),
 w AS (SELECT unit, source, len, n, sum(n) OVER (PARTITION BY unit, source) AS total, count(*) OVER (PARTITION BY unit, source) AS tests, sum(n) OVER (PARTITION BY unit, source ORDER BY len DESC) AS at_risk,
   {", ".join(_up_to(k, x) for k, x in enumerate(_OFFSETS))} FROM c),
 h AS (SELECT *, e1 - e0 AS below, e3 - e2 AS above, {_EXPOSED} AS exposed FROM w),
 m AS (SELECT *, greatest(at_risk * (below + above + 0.5) / exposed, (greatest(below, above) + 0.5) / {float(REACH - GUARD)}) AS expected FROM h WHERE exposed > 0),
 p AS (SELECT *, list_sum(list_transform(range(n, n + 1000), lambda j: exp(j * ln(expected) - expected - lgamma(j + 1)))) AS p FROM m WHERE n >= 2 AND n > expected),
 k AS (SELECT *, row_number() OVER (PARTITION BY unit, source ORDER BY p, len) AS place FROM p WHERE p <= {FALSE_DISCOVERIES}),
 limits AS (SELECT * FROM (SELECT *, max(CASE WHEN p <= place * {FALSE_DISCOVERIES} / tests THEN place END) OVER (PARTITION BY unit, source) AS last FROM k) WHERE place <= last)"""

P9_LIMITS = f"WITH {_LIMITS} SELECT source, len::INT AS length, n, at_risk::BIGINT AS at_risk, round(expected, 6) AS expected, round(p, 9) AS p, unit FROM limits"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FORMS = [
    ("whole IS NULL", "NULL"),
    ("whole = ''", "'blank'"),
    ("regexp_matches(ending, " + _quoted(r"(�|\\(u[0-9a-fA-F]{0,3})?|&(#?[0-9]{0,6}|[a-zA-Z]{1,6}))$") + ")", "'cut'"),
    ("regexp_matches(ending, " + _quoted(r"(…|\[\.\.\.\]|\[…\])$") + ")", "'cut'"),
    ("fences % 2 = 1", "'code'"),
    ("ends_with(ending, '```')", "'fence'"),
    ("ends_with(ending, '...')", "'dots'"),
    ("regexp_matches(line, " + _quoted(r"^(--|—|–)\s*\S+, \S+.*\w$") + ")", "'signature'"),
    ("regexp_matches(line, " + _quoted(r"^(\w+=\S+ +)+\w+=\S+$") + ")", "'status'"),
    ("regexp_matches(line, " + _quoted(r"^(\{.*\}|\[.*\])$") + ")", "'record'"),
    ("regexp_matches(line, " + _quoted(r"^\p{Lu}[\p{L}]+( \p{L}+)? ?: \S+$") + ") AND NOT regexp_matches(ending, '[.,;:]$')", "'reference'"),
    ("regexp_matches(ending, " + _quoted(r"(^|\s)[0-9]+\.$") + ")", "'open'"),
    ("regexp_matches(ending, " + _quoted(rf"[.?!]{_CLOSERS}$") + ") AND NOT (regexp_matches(line, " + _quoted(r"^([-*] )?\([^)]*$") + ") OR regexp_matches(line, " + _quoted(r'^([-*] )?"[^"]*$') + "))", "'sentence'"),
]
_FOUND = f"""WITH {_LIMITS},
 e AS (SELECT *, trim(string_split(whole, chr(10))[-1]) AS line, right(whole, 64) AS ending, (length(whole) - length(replace(whole, '```', ''))) // 3 AS fences FROM d),
 f AS (SELECT doc_id, source, text, whole, line, CASE {" ".join(f"WHEN {a} THEN {b}" for a, b in _FORMS)} ELSE 'open' END AS form FROM e),
 g AS (SELECT f.*, CASE WHEN form IN ('signature', 'status') THEN string_split(line, ' ')[-1] WHEN form = 'dots' THEN array_to_string(string_split(line, ' ')[1:2], ' ') END AS tail,
   EXISTS (SELECT 1 FROM limits l WHERE l.source IS NOT DISTINCT FROM f.source AND l.len = CASE WHEN l.unit = 'chars' THEN length(f.text) ELSE strlen(f.text) END) AS at_limit FROM f),
 n AS (SELECT form, tail, count(*) AS n FROM g WHERE tail IS NOT NULL AND (form <> 'dots' OR NOT at_limit) GROUP BY form, tail),
 usual AS (SELECT form, tail FROM (SELECT *, sum(n) OVER (PARTITION BY form) AS total FROM n) WHERE n / total >= CASE WHEN form = 'dots' THEN {_USUAL_DOTS} ELSE {_USUAL} END),
 q AS (SELECT g.*, form IN ('dots', 'signature', 'status') AND NOT EXISTS (SELECT 1 FROM usual u WHERE u.form = g.form AND u.tail = g.tail) AS doubtful,
   CASE WHEN form IN ('dots', 'signature', 'status') THEN md5(regexp_replace(regexp_replace(whole, '^{_SET}+', ''), '[\\s\\x0b]+', ' ', 'g')) END AS digest FROM g),
 t AS (SELECT doc_id, source, at_limit, coalesce(form IN ('cut', 'code', 'open') OR (doubtful AND (at_limit OR digest IN (SELECT digest FROM q WHERE doubtful AND at_limit))), false) AS truncated FROM q)
 """
P9_FOUND = _FOUND + "SELECT DISTINCT doc_id FROM t WHERE truncated"
P9_SOURCES = _FOUND + """SELECT source, count(*) AS n_docs, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (truncated AND at_limit) AS n_at_limit,
 count(*) FILTER (truncated) / count(*) AS share FROM t GROUP BY source"""
