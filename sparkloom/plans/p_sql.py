"""SQL that must give the rows of the queries of problems 1, 2, 4 and 6.

The engine that runs it is lenient about not-a-number and trailing commas in JSON, so those are looked for by pattern. A wide table needs the
names of its columns in the SQL; they are the declared keys and event types of a folder whose fixed tables are those of the data.
"""

from __future__ import annotations

import os

import pyarrow.parquet as pq

FIXED = "/root/testdata/sf0.01"


def _fixed(name: str, folder: str) -> list[tuple] | None:
    """Rows of a fixed table without nulls, sorted; None if it is not there."""
    path = f"{folder}/{name}.parquet"
    if not os.path.exists(path):
        return None
    return sorted(tuple(r.values()) for r in pq.read_table(path).to_pylist() if None not in r.values())


_P1_CELLS = r"""WITH g AS (SELECT job_id, mess_id, dest_peer, k.key, k.type, trim(g.value, chr(32) || chr(9) || chr(10) || chr(13)) AS v
   FROM globals g JOIN global_keys k ON lower(trim(g.key, chr(32) || chr(9) || chr(10) || chr(13))) = k.key WHERE g.value IS NOT NULL),
 u AS (SELECT * REPLACE (CASE WHEN regexp_full_match(v, '(?s)\{\s*"type"\s*:\s*"[^"]*"\s*,\s*"value"\s*:.*\}') THEN trim(regexp_extract(v, '(?s)"value"\s*:(.*)\}', 1)) ELSE v END AS v) FROM g),
 s AS (SELECT *, regexp_full_match(v, '(?s)"([^"\\]|\\.)*"') AS quoted FROM u WHERE v <> 'null'),
 t AS (SELECT *, CASE WHEN quoted THEN substring(v, 2, length(v) - 2) ELSE v END AS x FROM s),
 c AS (SELECT *, CASE type
   WHEN 'int' THEN CASE WHEN regexp_full_match(x, '-?(0|[1-9][0-9]{0,10})(\.0+)?') AND abs(TRY_CAST(regexp_replace(x, '\.0+$', '') AS BIGINT) + 0.5) < 2147483648 THEN CAST(CAST(regexp_replace(x, '\.0+$', '') AS BIGINT) AS VARCHAR) END
   WHEN 'real' THEN CASE WHEN regexp_full_match(x, '-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?') THEN CAST(CAST(x AS DOUBLE) + 0.0 AS VARCHAR) END
   WHEN 'bool' THEN CASE WHEN (CASE WHEN quoted THEN lower(x) ELSE x END) IN ('true', 'false') THEN lower(x) END
   WHEN 'string' THEN CASE WHEN quoted THEN x END
   WHEN 'address' THEN CASE WHEN quoted AND regexp_full_match(x, '((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]):[0-9]{1,5}') AND CAST(regexp_extract(x, ':([0-9]+)$', 1) AS INT) <= 65535 THEN x END
   ELSE CASE WHEN NOT quoted AND left(v, 1) IN ('[', '{') AND json_valid(v) THEN CAST(json(v) AS VARCHAR) END END AS canon FROM t)"""
P1 = _P1_CELLS + " SELECT job_id, mess_id, dest_peer, key FROM c GROUP BY ALL HAVING bool_or(canon IS NULL) OR count(DISTINCT canon) > 1"


JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|[^\s",:\[\]{}]+'


def p1_typed(folder: str = FIXED) -> str | None:
    """The wide table; collections as their sorted tokens, as this SQL can't put the keys of objects in order."""
    declared = _fixed("global_keys", folder)
    if declared is None:
        return None
    kinds = {"int": "INTEGER", "real": "DOUBLE", "bool": "BOOLEAN"}
    columns = []
    for key, kind in declared:
        text = "canon" if kind in kinds else f"array_to_string(list_sort(list_transform(regexp_extract_all(canon, '{JSON_TOKEN}'), lambda x: regexp_replace(x, '^(-?[0-9]+)\\.0+$', '\\1'))), ' ')" if kind == "collection" else "v->>'$'"
        columns.append(f"CAST(max(CASE WHEN key = '{key}' THEN {text} END) AS {kinds.get(kind, 'VARCHAR')}) AS \"{key}\"")
    return f"""{_P1_CELLS}, k AS (SELECT job_id, mess_id, dest_peer, key, any_value(v) AS v, any_value(quoted) AS quoted, max(canon) AS canon FROM c
   GROUP BY job_id, mess_id, dest_peer, key HAVING bool_and(canon IS NOT NULL) AND count(DISTINCT canon) = 1)
 SELECT job_id, mess_id, dest_peer, {", ".join(columns)} FROM (SELECT DISTINCT job_id, mess_id, dest_peer FROM globals) LEFT JOIN k USING (job_id, mess_id, dest_peer) GROUP BY job_id, mess_id, dest_peer"""


FIRST_ARRIVALS = "(SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY job_id, mess_id, dest_peer ORDER BY time NULLS FIRST, trigger NULLS FIRST, source_peer NULLS FIRST) = 1)"


def p6_wide(rows: str = "messages", folder: str = FIXED) -> str | None:
    """Three columns for every event type, from cells by conditional aggregates."""
    triggers = _fixed("trigger_list", folder)
    if triggers is None:
        return None
    features = {"count": "coalesce(max({c} n), 0)", "last_time": "max({c} last_time)", "sources": "coalesce(max({c} sources), 0)"}
    columns = [f"{e} AS \"{t}__{f}\"" for t in sorted({t for t, _ in triggers}) for f, e in ((f, e.format(c=f"CASE WHEN trigger = '{t}' THEN").replace(")", " END)", 1)) for f, e in features.items())]
    return f"""WITH c AS (SELECT dest_peer, trigger, count(*) AS n, max(time)::BIGINT AS last_time, count(DISTINCT source_peer) AS sources FROM {rows} GROUP BY ALL)
 SELECT dest_peer, {", ".join(columns)} FROM c GROUP BY dest_peer"""


_FIELD = "(?:'(?:[^']|'')*'|(?:[^|'][^|]*)?)"
_P2_LINES = r"""WITH l AS (SELECT line_id, job_id, file_name, line IS NULL AS no_line, coalesce(regexp_replace(line, '\r$', ''), '') AS line FROM trace_lines),
 m AS (SELECT *, regexp_full_match(line, '(?s)FIELD(\|FIELD){5}') AS ok FROM l),
 f AS (SELECT *, regexp_extract(line, '(?s)^(FIELD)\|(FIELD)\|(FIELD)\|(FIELD)\|(FIELD)\|(FIELD)$', ['f1', 'f2', 'f3', 'f4', 'f5', 'f6']) AS raw FROM m),
 u AS (SELECT *, list_transform([raw.f1, raw.f2, raw.f3, raw.f4, raw.f5, raw.f6], lambda x: CASE WHEN starts_with(x, '''') THEN replace(substring(x, 2, length(x) - 2), '''''', '''') ELSE x END) AS v FROM f),
 g AS (SELECT *, v[5] AS contents, trim(v[6], chr(32) || chr(9) || chr(10) || chr(13)) AS time FROM u),
 r AS (SELECT *, CASE WHEN no_line THEN 'null_line'
   WHEN regexp_full_match(line, '(?s)(FIELD\|)*''([^'']|'''')*') THEN 'unclosed_quote'
   WHEN regexp_matches(line, '(?s)^(FIELD\|)*''([^'']|'''')*''[^|'']') THEN 'text_after_quote'
   WHEN NOT ok THEN 'field_count'
   WHEN trim(contents, chr(32) || chr(9) || chr(10) || chr(13)) = '' THEN 'contents_empty'
   WHEN NOT json_valid(contents) OR regexp_matches(contents, '[:,\[]\s*-?(NaN|Infinity|nan|inf)|,\s*[}\]]') OR regexp_matches(contents, '^\s*-?(NaN|Infinity)') THEN 'contents_not_json'
   WHEN time = '' THEN 'time_empty'
   WHEN NOT regexp_full_match(time, '[0-9]+') THEN 'time_not_digits'
   WHEN coalesce(TRY_CAST(time AS HUGEINT) > 2147483647, true) THEN 'time_range' END AS reason FROM g)""".replace("FIELD", _FIELD.replace("'", "''"))
P2 = _P2_LINES + " SELECT line_id FROM r WHERE reason IS NOT NULL"
P2_REJECTS = _P2_LINES + " SELECT line_id, job_id, file_name, reason FROM r WHERE reason IS NOT NULL"
P2_MESSAGES = _P2_LINES + r""" SELECT line_id, job_id, file_name, CASE WHEN regexp_full_match(trim(v[1]), '[+-]?[0-9]+') THEN TRY_CAST(trim(v[1]) AS INT) END AS mess_id,
   CASE WHEN raw.f2 NOT IN ('', 'null') THEN v[2] END AS dest_peer, CASE WHEN raw.f3 NOT IN ('', 'null') THEN v[3] END AS trigger, CASE WHEN raw.f4 NOT IN ('', 'null') THEN v[4] END AS source_peer,
   contents, CAST(time AS INT) AS time FROM r WHERE reason IS NULL"""
P4 = r"""WITH RECURSIVE w(src, job_id, mess_id, dest_peer, bid, j) AS (
   SELECT 'messages', job_id, mess_id, dest_peer, NULL::BIGINT, contents::JSON FROM messages WHERE contains(contents, 'did')
   UNION ALL SELECT 'globals', job_id, mess_id, dest_peer, NULL::BIGINT, value::JSON FROM globals WHERE contains(value, 'did') AND lower(trim(key, chr(32) || chr(9))) = 'pending_log' AND json_valid(value)
   UNION ALL SELECT w.src, w.job_id, w.mess_id, w.dest_peer, coalesce(CASE WHEN json_type(w.j) = 'OBJECT' THEN TRY_CAST(json_extract_string(w.j, '$.bid') AS BIGINT) END, w.bid),
     CASE WHEN e.type = 'VARCHAR' THEN (e.value->>'$')::JSON ELSE e.value END
   FROM w, json_each(w.j) e WHERE e.type IN ('OBJECT', 'ARRAY') OR (e.type = 'VARCHAR' AND left(ltrim(e.value->>'$'), 1) IN ('[', '{') AND json_valid(e.value->>'$')))
 SELECT DISTINCT src, job_id, mess_id, dest_peer, bid, TRY_CAST(json_extract_string(j, '$.did') AS BIGINT) AS did FROM w WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.did')"""

# every object at any depth with the batch, map and change nearest around it
_OBJECTS = r"""WITH RECURSIVE w(src, job_id, mess_id, dest_peer, bid, map, did, j) AS (
   SELECT 'messages', job_id, mess_id, dest_peer, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, contents::JSON FROM messages WHERE json_valid(contents) AND regexp_matches(contents, 'did|bid|name')
   UNION ALL SELECT 'globals', job_id, mess_id, dest_peer, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, value::JSON FROM globals WHERE lower(trim(key, chr(32) || chr(9))) = 'pending_log' AND json_valid(value)
   UNION ALL SELECT w.src, w.job_id, w.mess_id, w.dest_peer,
     CASE WHEN json_type(w.j) = 'OBJECT' AND json_exists(w.j, '$.bid') THEN TRY_CAST(json_extract_string(w.j, '$.bid') AS BIGINT) ELSE w.bid END,
     CASE WHEN json_type(w.j) = 'OBJECT' AND json_exists(w.j, '$.name') THEN json_extract_string(w.j, '$.name') ELSE w.map END,
     CASE WHEN json_type(w.j) = 'OBJECT' AND json_exists(w.j, '$.did') THEN TRY_CAST(json_extract_string(w.j, '$.did') AS BIGINT) ELSE w.did END,
     CASE WHEN e.type = 'VARCHAR' THEN (e.value->>'$')::JSON ELSE e.value END
   FROM w, json_each(w.j) e WHERE e.type IN ('OBJECT', 'ARRAY') OR (e.type = 'VARCHAR' AND left(ltrim(e.value->>'$'), 1) IN ('[', '{') AND json_valid(e.value->>'$')))
 SELECT DISTINCT src, job_id, mess_id, dest_peer, """
P4_BATCHES = _OBJECTS + r"""bid AS parent_bid, TRY_CAST(json_extract_string(j, '$.bid') AS BIGINT) AS bid, TRY_CAST(json_extract_string(j, '$.stmt') AS INT) AS stmt
 FROM w WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.bid')"""
P4_MAPS = _OBJECTS + r"""bid, json_extract_string(j, '$.name') AS name FROM w WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.name')"""
P4_CHANGES = _OBJECTS + r"""bid, map, did AS parent_did, TRY_CAST(json_extract_string(j, '$.did') AS BIGINT) AS did, array_to_string(TRY_CAST(j->'$.key' AS BIGINT[]), ',') AS key,
   TRY_CAST(json_extract_string(j, '$.mult') AS INT) AS mult, TRY_CAST(json_extract_string(j, '$.val.sum') AS DOUBLE) AS val_sum, TRY_CAST(json_extract_string(j, '$.val.cnt') AS BIGINT) AS val_cnt
 FROM w WHERE json_type(j) = 'OBJECT' AND json_exists(j, '$.did')"""
